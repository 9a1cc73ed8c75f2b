"""Append-only logs: current state, replays, evidence, admission, run aggregation and selection. `seq` is the clock."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_state(log: DataFrame, key: str, seq: list[str], fields: list[str]) -> DataFrame:
    """The last record of each key (W5); one pass with partial aggregation, no sort."""
    order = F.struct(*seq)
    return log.groupBy(key).agg(*(F.max_by(f, order).alias(f) for f in fields), F.count("*").alias("n_records"))


def effective(state: DataFrame, action: str = "action") -> DataFrame:
    """Keys whose last action isn't a rejection (T4)."""
    return state.where(F.col(action) != "reject")


def without_replays(log: DataFrame, key: str, seq: list[str], content: list[str]) -> DataFrame:
    """Records that differ from the same key's record before."""
    before = F.lag(F.struct(*content)).over(Window.partitionBy(key).orderBy(*seq))
    return log.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.struct(*content))).drop("_b")


def transitions(log: DataFrame, key: str, seq: list[str], state: str) -> DataFrame:
    """How often each state follows each."""
    pairs = log.select(F.lag(state).over(Window.partitionBy(key).orderBy(*seq)).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def bad_transitions(log: DataFrame, key: str, seq: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    moves = log.select(key, F.lag(state).over(Window.partitionBy(key).orderBy(*seq)).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    table = log.sparkSession.createDataFrame(allowed, "from_state string, to_state string")
    return moves.join(F.broadcast(table), ["from_state", "to_state"], "left_anti")


def cap_per_group(df: DataFrame, group: str, order: list[str], cap: int, exempt: str | None = None) -> DataFrame:
    """The first `cap` rows of each group; exempt rows always stay."""
    plain = df if exempt is None else df.where(~F.col(exempt))
    kept = plain.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")
    return kept if exempt is None else kept.unionByName(df.where(exempt))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the earliest."""
    every = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*every), F.struct(*order)).alias("_f")).select(key, "_f.*")


def selected_evidence(machine: DataFrame, excluded: DataFrame, manual: DataFrame) -> DataFrame:
    """Machine rows not excluded, then manual rows, numbered E1.. within a finding.
    machine, manual (finding_id, evidence_id, rank); excluded (finding_id, evidence_id)."""
    kept = machine.join(excluded, ["finding_id", "evidence_id"], "left_anti").withColumn("part", F.lit(0))
    every = kept.unionByName(manual.withColumn("part", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("finding_id").orderBy("part", "rank", "evidence_id"))
    return every.select("finding_id", F.concat(F.lit("E"), n).alias("label"), "evidence_id", "part")


def admit_jobs(log: DataFrame, key: str, seq: list[str], status: str, terminal: list[str], keep: int) -> DataFrame:
    """A job's first terminal status sticks, else its last; of terminal jobs the `keep` latest are retained."""
    end = F.col(status).isin(terminal)
    order = F.struct(*seq)
    state = log.groupBy(key).agg(F.min_by(F.when(end, F.col(status)), F.when(end, order)).alias("t"), F.max_by(status, order).alias("l"), F.max(order).alias("o"))
    state = state.select(key, F.coalesce("t", "l").alias("status"), "o")
    done = state.where(F.col("status").isin(terminal)).orderBy(F.desc("o"), key).limit(keep)
    return state.where(~F.col("status").isin(terminal)).unionByName(done).select(key, "status")


def run_repeats(cases: DataFrame, key: str, given: str, repeats: int, work: Callable[[str], str]) -> DataFrame:
    """key, repeat, status, output, error: each case's text through the caller's work as often as stated (X24). What fails is
    a row like others, with the kind and text of its error; nothing is tried twice."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for case, repeat, text in part.itertuples(index=False):
                try:
                    rows.append((case, repeat, "ok", work(text), None))
                except Exception as e:
                    rows.append((case, repeat, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "repeat", "status", "output", "error"])

    every = cases.select(key, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), given)
    return every.mapInPandas(run, f"{key} {cases.schema[key].dataType.simpleString()}, repeat int, status string, output string, error string")


def run_aggregate(runs: DataFrame, repeats: int, recalls: Sequence[str] = (), forbidden: str | None = None) -> DataFrame:
    """run, valid_rate, repeatability (G16): a case repeats if all its repeats ran and its ok outputs are one; further the
    mean of each recall over ok rows (0 without any) and the sum of forbidden hits. runs(run, case_id, status, output)."""
    ok = F.col("status") == "ok"
    extra = {f"_s_{c}": F.sum(F.when(ok, F.col(c))) for c in recalls} | ({"_f": F.sum(forbidden)} if forbidden else {})
    case = runs.groupBy("run", "case_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_distinct(F.when(ok, F.col("output"))).alias("outputs"), *(e.alias(k) for k, e in extra.items()))
    out = [F.round(F.sum("ok") / F.sum("n"), 6).alias("valid_rate"), F.round(F.avg(((F.col("n") >= repeats) & (F.col("outputs") == 1)).cast("int")), 6).alias("repeatability")]
    out += [F.round(F.when(F.sum("ok") > 0, F.coalesce(F.sum(f"_s_{c}"), F.lit(0.0)) / F.sum("ok")).otherwise(0.0), 6).alias(c) for c in recalls]
    return case.groupBy("run").agg(*out, *([F.coalesce(F.sum("_f"), F.lit(0)).cast("long").alias(forbidden)] if forbidden else []))


def select_winner(aggregates: DataFrame, veto: str, order: list[str], key: str) -> DataFrame:
    """Vetoed candidates go first, then the best by falling order."""
    return aggregates.where(~F.col(veto)).orderBy(*(F.desc(c) for c in order), key).limit(1)


def interleave(pools: list[DataFrame], id_col: str, limit: int) -> DataFrame:
    """Round robin over pools in their order, then the limit (S16, W9). Each pool keeps only what the limit can take."""
    out = None
    for i, pool in enumerate(pools):
        top = pool.select(F.col(id_col).alias("id")).orderBy("id").limit(limit)
        top = top.select("id", F.lit(i).alias("pool"), F.row_number().over(Window.orderBy("id")).alias("turn"))
        out = top if out is None else out.unionByName(top)
    ordered = out.orderBy("turn", "pool").limit(limit)
    return ordered.select("pool", "id", F.row_number().over(Window.orderBy("turn", "pool")).alias("position"))


def category_rollup(scenarios: DataFrame, checks: DataFrame, key: str, category: str) -> DataFrame:
    """category, scenarios, score (G18): a scenario scores its share of passed checks, one without any (a crash) 0.
    scenarios (key, category), checks (key, ok)."""
    per = checks.groupBy(key).agg(F.count("*").alias("checks"), F.count_if("ok").alias("passed"))
    every = scenarios.select(key, category).join(per, key, "left")
    return every.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("scenarios"), F.round(F.sum(F.coalesce(F.col("passed") / F.col("checks"), F.lit(0.0))), 4).alias("score"))


def joined_text(df: DataFrame, key: str, value: str, order: str, separator: str = "; ") -> DataFrame:
    """key, joined, n: a key's values in order as one text."""
    return df.groupBy(key).agg(F.expr(f"listagg({value}, '{separator}') within group (order by {order}, {value})").alias("joined"), F.count("*").alias("n"))


def reusable_jobs(wanted: DataFrame, state: DataFrame, same: list[str], active: list[str]) -> DataFrame:
    """Each wanted job with the first active job that does the same, or null where a new one must start."""
    running = state.where(F.col("status").isin(active)).groupBy(*same).agg(F.min("job").alias("job"))
    return wanted.join(running, same, "left")


def winner_or_status(aggregates: DataFrame, veto: str, order: list[str], key: str) -> DataFrame:
    """key, status: the winner as `selected`, or one row `no_candidate`."""
    one = aggregates.sparkSession.range(1).select(F.lit(1).alias("_j"))
    best = select_winner(aggregates, veto, order, key).select(key, F.lit(1).alias("_j"))
    return one.join(best, "_j", "left").select(key, F.when(F.col(key).isNull(), "no_candidate").otherwise("selected").alias("status"))
