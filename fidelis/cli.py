"""python -m fidelis.cli ARCHIVE OUT: games to a cohort's ordered decisions, with a manifest."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.operators import sessions
from fidelis.sources import readers
from fidelis.sources.archives import archive_games


def ingest(spark: SparkSession, archive: str, out: str, speed: str = "blitz", min_games: int = 50, min_sessions: int = 3, max_players: int | None = None, gap: float = 1800.0, max_games: int | None = None) -> dict:
    """Two passes over the archive's ranges: headers choose the cohort, then only its games are read move by move. Writes decisions
    and manifest; returns the manifest. Other speeds, and in pass two other players where max_players bounds their list, do not
    leave the reader."""
    games = readers.game_headers(archive_games(spark, archive, speed).select("block")).filter(F.col("speed") == speed)
    seen = readers.real_players(readers.both_players(games.drop("block")))
    timed = sessions.decisions(seen, "player", ["utc_start", "white", "black"])
    stats = sessions.player_stats(sessions.with_sessions(timed, "player", "utc_start", gap), "player", "utc_start")
    cohort = stats.filter((F.col("n_games") >= min_games) & (F.col("n_sessions") >= min_sessions))
    if max_players is not None:
        names = [r["player"] for r in cohort.orderBy(F.desc("n_games"), "player").limit(max_players).select("player").collect()]
        cohort = spark.createDataFrame([(n,) for n in names], "player string")
        if names and not any("," in n for n in names):
            games = readers.game_headers(archive_games(spark, archive, speed, names).select("block"))
    write = decisions(games, cohort, gap, max_games)
    write.write.mode("error").partitionBy("speed").parquet(f"{out}/decisions")
    back = spark.read.parquet(f"{out}/decisions")
    facts = {"speed": speed, "min_games": min_games, "min_sessions": min_sessions, "gap": gap, "players": back.select("player").distinct().count(), "decisions": back.count()}
    if not facts["players"]:
        raise SystemExit("no player passes the gates")
    readers.manifest(spark, f"{out}/manifest", facts)
    return facts


def decisions(games: DataFrame, cohort: DataFrame, gap: float, max_games: int | None) -> DataFrame:
    """One row per own move of the cohort's players, in order of games and moves."""
    both = readers.real_players(readers.both_players(games)).join(cohort.select("player"), "player", "left_semi")
    both = sessions.with_sessions(both.withColumn("t", (F.row_number().over(Window.partitionBy("player").orderBy(F.col("utc_start").asc_nulls_last(), "white", "black")) - 1).cast("long")), "player", "utc_start", gap)
    both = both.withColumnRenamed("t", "game")
    if max_games is not None:
        both = both.filter(F.col("game") < max_games)
    plies = readers.game_plies(both, ["player", "game"])
    mine = plies.join(both.select("player", "game", "session", "session_pos", "won", "elo", "speed", F.when(F.col("player") == F.col("white"), "white").otherwise("black").alias("side")), ["player", "game", "side"])
    return sessions.decisions(mine, "player", ["game", "ply"]).withColumnRenamed("san", "action")


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("archive")
    a.add_argument("out")
    a.add_argument("--speed", default="blitz")
    a.add_argument("--min-games", type=int, default=50)
    a.add_argument("--min-sessions", type=int, default=3)
    a.add_argument("--max-players", type=int)
    a.add_argument("--max-games", type=int)
    a.add_argument("--gap", type=float, default=1800.0)
    x = a.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(ingest(spark, x.archive, x.out, x.speed, x.min_games, x.min_sessions, x.max_players, x.gap, x.max_games))


if __name__ == "__main__":
    main()
