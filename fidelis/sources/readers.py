"""Readers and writers. All return or take DataFrames; schemas are given, never inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions.scalars import safe_int, speed_class, time_control, utc_seconds

SCHEMA_VERSION = 1
GAME_HEADERS = ("White", "Black", "Result", "WhiteElo", "BlackElo", "WhiteTitle", "BlackTitle", "TimeControl", "UTCDate", "UTCTime")
TRAJECTORY = (
    "schema_version int, n_trajectories long, player_id string, "
    "streams array<struct<recent:array<struct<won:boolean,margin:double,engine_swing:double,blunders:int,time_scramble:boolean,gap_to_next_seconds:double>>,session_position:int>>, "
    "decisions array<struct<game:string,state:string,legal_actions:array<string>,time_signal:struct<time_remaining:double,increment:double,time_spent:double,move_number:int,phase:string>,recent_outcomes:int,context:map<string,string>>>, "
    "observations array<struct<move:string,time_spent:double>>"
)


def pgn_games(spark: SparkSession, path: str) -> DataFrame:
    """One row per game block of PGN text (plain, gz, or any codec Spark reads): block. Records are split by Spark's reader at each event tag."""
    text = spark.read.option("lineSep", "\n[Event ").text(path)
    return text.filter(F.trim("value") != "").select(F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value"))).alias("block"))


def game_headers(games: DataFrame) -> DataFrame:
    """Header columns of each block, without reading its moves."""
    tag = lambda name: F.nullif(F.regexp_extract("block", rf'\[{name} "([^"]*)"\]', 1), F.lit(""))
    h = games.select("*", *[tag(n).alias(n) for n in GAME_HEADERS])
    tc = time_control("TimeControl")
    return h.select(
        F.col("White").alias("white"), F.col("Black").alias("black"), F.col("Result").alias("result"), safe_int("WhiteElo").alias("white_elo"), safe_int("BlackElo").alias("black_elo"),
        F.coalesce(F.col("WhiteTitle") == "BOT", F.lit(False)).alias("white_is_bot"), F.coalesce(F.col("BlackTitle") == "BOT", F.lit(False)).alias("black_is_bot"),
        F.col("TimeControl").alias("time_control"), speed_class("TimeControl").alias("speed"), tc["base"].alias("base"), tc["inc"].alias("inc"), utc_seconds("UTCDate", "UTCTime").alias("utc_start"), "block",
    )


def game_plies(games: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ply (from 0), side, san, clock_before, time_spent from movetext with clock comments: clock - clock after + increment, per side, at least 0."""
    moves = F.regexp_replace(F.regexp_replace("block", r"(?s)^.*\]\s*\n\s*\n", ""), r"\$\d+", "")
    found = F.regexp_extract_all(moves, F.lit(r"(?:\d+\.+\s*)?([KQRBNOa-h][^\s{}]*)\s*\{[^}]*?\[%clk (\d+:\d+:\d+(?:\.\d+)?)\][^}]*\}"), 0)
    one = games.select(*keys, "base", "inc", F.posexplode(found).alias("ply", "_m"))
    clock = F.split(F.regexp_extract("_m", r"\[%clk ([\d:.]+)\]", 1), ":")
    sec = F.element_at(clock, 1).cast("double") * 3600 + F.element_at(clock, 2).cast("double") * 60 + F.element_at(clock, 3).cast("double")
    rows = one.select(*keys, "base", "inc", "ply", (F.col("ply") % 2).alias("_side"), F.regexp_extract("_m", r"^(?:\d+\.+\s*)?([^\s{}]+)", 1).alias("san"), sec.alias("_clk"))
    w = Window.partitionBy(*keys, "_side").orderBy("ply")
    had = F.coalesce(F.lag("_clk").over(w), F.col("base"))
    return rows.select(*keys, "ply", F.when(F.col("_side") == 0, "white").otherwise("black").alias("side"), "san", had.alias("clock_before"), F.greatest(F.lit(0.0), had - F.col("_clk") + F.coalesce("inc", F.lit(0.0))).alias("time_spent"))


def both_players(games: DataFrame) -> DataFrame:
    """Each game under both players: player, opponent, elo, bots, won (null for a draw or unknown)."""
    side = lambda me, you, score: F.struct(F.col(me).alias("player"), F.col(you).alias("opponent"), F.col(f"{me}_elo").alias("elo"), F.col(f"{me}_is_bot").alias("is_bot"), F.col(f"{you}_is_bot").alias("opponent_is_bot"), F.when(F.col("result") == score, True).when(F.col("result").isin("1-0", "0-1"), False).alias("won"))
    return games.withColumn("_p", F.explode(F.array(side("white", "black", "1-0"), side("black", "white", "0-1")))).select("*", "_p.*").drop("_p")


def real_players(rows: DataFrame, include_bots: bool = False, exclude_bot_opponents: bool = True) -> DataFrame:
    out = rows.filter("player != '?'")
    out = out if include_bots else out.filter("not is_bot")
    return out.filter("not opponent_is_bot") if exclude_bot_opponents else out


def responses_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw response log (ISO-8859-1): rows with correct 0 or 1 and a skill, the first of each order id that survives, by order id. File order is the reader's."""
    schema = "order_id string, user_id string, problem_id string, correct string, skill_id string, ms_first_response string"
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").schema(schema).csv(path)
    raw = raw.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("correct").isin("0", "1") & (F.coalesce("skill_id", F.lit("")) != ""))
    return raw.withColumn("_n", F.row_number().over(Window.partitionBy("order_id").orderBy("_row"))).filter("_n = 1").select(F.col("order_id").cast("long"), "user_id", "problem_id", F.col("correct").cast("int"), "skill_id", F.col("ms_first_response").try_cast("double").alias("ms"))


def response_trajectories(rows: DataFrame, user: str, order: list[str], correct: str, skill: str, ms: str, n_users: int | None = 500, least: int = 50, most: int = 200, train: float = 0.7) -> DataFrame:
    """user, t, k, correct, skill, seconds (ms / 1000 within 0.5 to 300), difficulty. Users with at least `least` rows, the first n_users by order, their first `most` rows;
    difficulty is 1 - mean correct over training rows of these users and all kept rows of others, 0.5 where unseen."""
    timed = rows.filter(F.col(ms).try_cast("double").isNotNull()).withColumn("seconds", F.greatest(F.lit(0.5), F.least(F.lit(300.0), F.col(ms).try_cast("double") / 1000)))
    w = Window.partitionBy(user)
    timed = timed.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("t", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).filter(F.col("t") < most)
    firsts = timed.filter(F.col("_n") >= least).groupBy(user).agg(F.min(F.struct(*order)).alias("_first"))
    if n_users is not None:
        firsts = firsts.orderBy("_first", user).limit(n_users)
    chosen = firsts.select(user, F.lit(True).alias("_in"))
    all_rows = timed.join(chosen, user, "left").withColumn("k", F.bround(F.least("_n", F.lit(most)) * train, 0).cast("long"))
    hard = all_rows.filter(F.col("_in").isNull() | (F.col("t") < F.col("k"))).groupBy(skill).agg((1 - F.avg(correct)).alias("difficulty"))
    return all_rows.filter("_in").join(hard, skill, "left").select(user, "t", "k", F.col(correct).alias("correct"), skill, "seconds", F.coalesce("difficulty", F.lit(0.5)).alias("difficulty"))


def parquet_shards(spark: SparkSession, path: str, columns: list[str], shards: int | None = None) -> DataFrame:
    """A folder of Parquet files; with shards the number of files is checked."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    if shards is not None and (n := len(df.inputFiles())) != shards:
        raise ValueError(f"{n} shards, {shards} expected")
    return df.select(*columns)


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """The trajectory store (JSON lines, plain or gz): player_id, streams, decisions, observations. A header line is optional; its version must be ours."""
    raw = spark.read.schema(TRAJECTORY).json(path)
    wrong = raw.filter(F.col("schema_version").isNotNull() & (F.col("schema_version") != SCHEMA_VERSION)).select("schema_version").limit(1).collect()
    if wrong:
        raise ValueError(f"schema version {wrong[0][0]}, {SCHEMA_VERSION} expected")
    return raw.filter("player_id is not null").drop("schema_version", "n_trajectories")


def trajectory_rows(store: DataFrame) -> DataFrame:
    """One row per decision with its observation and the outcomes that it points at."""
    rows = store.select("player_id", "streams", F.posexplode(F.arrays_zip("decisions", "observations")).alias("t", "_x"))
    d = F.col("_x.decisions")
    return rows.select("player_id", F.col("t").cast("long").alias("t"), d["game"].alias("game"), d["state"].alias("state"), d["legal_actions"].alias("legal_actions"), d["time_signal"].alias("time_signal"), d["context"].alias("context"), F.get("streams", d["recent_outcomes"]).alias("recent"), F.col("_x.observations.move").alias("action"), F.col("_x.observations.time_spent").alias("seconds"))


def write_trajectories(store: DataFrame, path: str) -> None:
    store.write.mode("error").option("compression", "gzip").json(path)


def contexts(spark: SparkSession, path: str) -> DataFrame:
    """context_id, turns from lines that hold a map of one key each."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,array<struct<role:string,content:string>>>").alias("m"))
    checked = raw.select(F.when(F.size("m") == 1, F.col("m")).otherwise(F.raise_error(F.lit("a line without exactly one key"))).alias("m"))
    return checked.select(F.explode("m").alias("context_id", "turns"))


def samples(spark: SparkSession, path: str, k: int = 8) -> DataFrame:
    """key, arm, texts: k samples in order; an incomplete set is an error."""
    raw = spark.read.schema("key string, arm string, k int, text string, generated_tokens int, terminal boolean").json(path)
    sets = raw.groupBy("key", "arm").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("s"))
    return sets.select("key", "arm", F.when(F.size("s") == k, F.col("s.text")).otherwise(F.raise_error(F.lit("an incomplete set of samples"))).alias("texts"))


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a completed record."""
    return jobs.join(done.filter("error is null").select(*keys).distinct(), keys, "left_anti")


def last_records(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last record per key wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).filter("_n = 1").drop("_n")


def manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """One sorted JSON record in a folder of its own."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(path)
