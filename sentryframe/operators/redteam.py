"""Adversarial variants of known attacks, rounds against a detector, and when to stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut
from ..config import FILLER, SYNONYMS, TEMPLATES, Calibration
from ..functions.decisions import normalized, pick
from .memory import screener, step

Generator = Callable[[DataFrame, int, int], DataFrame] | None
ZERO_WIDTH = "​"


def swap_synonyms(text: Column, *keys: Column) -> Column:
    """Each listed word replaced by one of its synonyms, chosen per text and word; case is ignored."""
    for word, options in SYNONYMS.items():
        text = F.regexp_replace(text, F.lit(rf"(?i)\b{word}\b"), pick(options, *keys, F.lit(word)))
    return text


def obfuscations(text: Column) -> dict[str, Column]:
    return {
        "digits": F.translate(text, "eai", "341"),
        "dots": F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.concat(w, F.lit("."))), " "),
        "upper": F.upper(text),
        "reverse": F.reverse(text),
        "zero_width": F.array_join(F.filter(F.split(text, ""), lambda c: c != ""), ZERO_WIDTH),
    }


def obfuscate(text: Column, *keys: Column) -> Column:
    forms = obfuscations(text)
    name, out = pick(tuple(forms), *keys, F.lit("obfuscation")), None
    for k, c in forms.items():
        out = F.when(name == k, c) if out is None else out.when(name == k, c)
    return out


def in_template(text: Column, *keys: Column) -> Column:
    return F.replace(pick(TEMPLATES, *keys, F.lit("template")), F.lit("{attack}"), text)


def dilute(text: Column, *keys: Column, filler: str = FILLER) -> Column:
    """The text before, after or in the middle of one to three copies of harmless filler."""
    times = pick(("1", "2", "3"), *keys, F.lit("times")).cast("int")
    around = F.array_join(F.array_repeat(F.lit(filler), times), " ")
    half = F.floor(F.length(around) / 2).cast("int")
    where = pick(("start", "middle", "end"), *keys, F.lit("where"))
    middle = F.concat_ws(" ", F.substr(around, F.lit(1), half), text, F.substr(around, half + 1))
    return F.when(where == "start", F.concat_ws(" ", around, text)).when(where == "end", F.concat_ws(" ", text, around)).otherwise(middle)


def variants(pool: DataFrame, n: int, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """n variants per seed attack: strategy i mod 4; the base text is drawn from the attack and its evasions so far.

    pool: seed_id, text, evasions (array) and columns to keep. Draws are hashes of the seed, attack and i, so reruns agree."""
    rows = pool.select("seed_id", *keep, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.concat(F.array("text"), F.coalesce("evasions", F.expr("array()").cast("array<string>"))).alias("bases"))
    keys = (F.lit(seed), F.col("seed_id"), F.col("i"))
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit("base")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("base", F.element_at("bases", (draw % F.size("bases") + 1).cast("int"))).withColumn("strategy", F.pmod("i", F.lit(4)))
    base, strategy = F.col("base"), F.col("strategy")
    text = F.when(strategy == 0, swap_synonyms(base, *keys)).when(strategy == 1, obfuscate(base, *keys)).when(strategy == 2, in_template(base, *keys)).otherwise(dilute(base, *keys))
    return rows.select("seed_id", *keep, "i", "strategy", text.alias("text"))


def red_team_round(pool: DataFrame, memory: DataFrame, score: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], n: int, round_no: int = 0, known_at: float = 0.9, c: Calibration = Calibration(), seed: int = 42, generate: Generator = None) -> DataFrame:
    """One round for all seed attacks at once. pool: seed_id, text, evasions, threshold.

    generate makes seed_id, i and text of n variants from pool, n and a seed (variants, unless another one is given); of an
    outside generator's rows those with null or blank text are left out.

    Variants near the memory (idx, embedding) as of the round's start are screened out. The rest are scored, and per seed attack one
    ordered fold of at most n variants goes through them, for the threshold moves with every evasion. Variants are
    made, screened and scored in one pass, and a shuffle brings each seed attack's together, with the texts of those that may evade."""
    pool = pool.repartition(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed_id")
    made = variants(pool, n, seed + round_no, ("threshold",)) if generate is None else generate(pool, n, seed + round_no).select("seed_id", "i", "text").filter("trim(text) != ''")
    scored = score(embed(made).withColumn("screened", screener(memory, known_at)(F.col("embedding"))))
    if generate is None:  # no threshold of a round is above its first one and the lower bound
        scored = scored.withColumn("text", F.when((F.col("score") >= F.col("threshold")) & (F.col("score") >= c.low), F.lit(None)).otherwise(F.col("text")))
    per = scored.groupBy("seed_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_generated"),
        F.count_if("screened").cast("int").alias("n_screened_out"),
        F.array_sort(F.collect_list(F.when(~F.col("screened"), F.struct("i", "score", "text")))).alias("tries"),
    )
    start = F.struct(F.col("threshold").cast("double").alias("threshold"), F.lit(0).alias("caught"), F.expr("cast(array() as array<string>)").alias("evaded"))

    def play(s, x):
        caught = x["score"] >= s["threshold"]
        return F.struct(
            F.when(caught, s["threshold"]).otherwise(step(s["threshold"], x["score"], F.lit(True), c)).alias("threshold"),
            (s["caught"] + caught.cast("int")).alias("caught"),
            F.when(caught, s["evaded"]).otherwise(F.array_append(s["evaded"], x["text"])).alias("evaded"),
        )

    end = pool.join(per, "seed_id").withColumn("end", F.aggregate("tries", start, play))
    evaded = F.size("end.evaded")
    return end.select("seed_id", F.lit(round_no).alias("round_index"), "n_generated", "n_screened_out", F.col("end.caught").alias("n_caught"), evaded.alias("n_evaded"), F.coalesce(F.try_divide(evaded, evaded + F.col("end.caught")), F.lit(0.0)).alias("evasion_rate"), F.col("end.evaded").alias("evasions"), F.col("end.threshold").alias("threshold"))


def red_team_loop(pool: DataFrame, memory: DataFrame, score, embed, n: int, rounds: int, carry: int = 10, stop_below: float = 0.1, stop_after: int | None = None, seed: int = 42, generate: Generator = None) -> DataFrame:
    """Rounds for all seed attacks together; the last `carry` evasions join the next round's bases and all of them the memory.

    A seed attack stops when its last stop_after rounds stayed below stop_below. Each round is written to the checkpoint folder, and
    of what it adds to the memory the vectors, once."""
    spark, results, memory = pool.sparkSession, None, memory.select("idx", "embedding")
    state = pool.select("seed_id", "text", F.expr("cast(array() as array<string>)").alias("evasions"), F.lit(Calibration().start).alias("threshold"), F.lit(0).alias("quiet"))
    for r in range(rounds):
        done = cut(red_team_round(state.drop("quiet"), memory, score, embed, n, r, seed=seed, generate=generate))
        results = done if results is None else results.unionByName(done)
        if r == rounds - 1:
            break
        new = embed(done.select("seed_id", F.posexplode("evasions").alias("k", "text")))
        added = new.select(F.xxhash64("seed_id", F.lit(r), "k").alias("idx"), normalized(F.col("embedding")).alias("embedding"))
        memory = memory.unionByName(cut(added))
        last = done.select("seed_id", F.col("evasions").alias("new"), F.col("threshold").alias("t"), "evasion_rate")
        all_ = F.concat("evasions", "new")
        state = state.join(last, "seed_id").select("seed_id", "text", F.slice(all_, F.greatest(F.size(all_) - (carry - 1), F.lit(1)), carry).alias("evasions"), F.col("t").alias("threshold"), F.when(F.col("evasion_rate") < stop_below, F.col("quiet") + 1).otherwise(0).alias("quiet"))
        if stop_after:
            state = state.filter(F.col("quiet") < stop_after)
        state = cut(state)
        if state.isEmpty():
            break
    return results if results is not None else spark.createDataFrame([], "seed_id long")


def stops(rounds: DataFrame, mode: str, cap: int = 100, fixed: int = 10, k: int = 3, below: float = 0.1, budget_seconds: float = 3600.0) -> DataFrame:
    """run_id and the first round index after which its run stops (null: goes on). rounds: run_id, round_index, evasion_rate, elapsed."""
    w = Window.partitionBy("run_id").orderBy("round_index")
    played = F.row_number().over(w)
    last = w.rowsBetween(-(k - 1), 0)
    rules = {
        "fixed_rounds": played >= fixed,
        "plateau": (F.count(F.lit(1)).over(last) == k) & (F.max("evasion_rate").over(last) < below),
        "budget": F.col("elapsed") >= budget_seconds,
    }
    if mode not in rules:
        raise ValueError(f"unknown mode {mode!r}")
    marked = rounds.withColumn("stop", (played >= cap) | rules[mode])
    return marked.groupBy("run_id").agg(F.min(F.when(F.col("stop"), F.col("round_index"))).alias("stop_after"))
