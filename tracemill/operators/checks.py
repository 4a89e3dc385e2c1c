"""Checks of records and datasets: violations as rows, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import hashing, trace, transcripts


def record_violations(e: str = "expression", messages: str = "messages") -> Column:
    """array<string> with the names of the checks that a record fails."""
    text, calls = F.col(e), transcripts.expected_calls(F.col(messages))
    shape, results = X.structure_of_text(text), F.transform(transcripts.observations(F.col(messages)), transcripts.read_result)
    called = F.filter(F.col(messages), lambda m: m["tool_calls"].isNotNull())
    ids = F.transform(called, lambda m: F.get(m["tool_calls"], F.lit(0))["id"])
    answered = F.transform(F.filter(F.col(messages), lambda m: m["role"] == "tool"), lambda m: m["tool_call_id"])
    worked = F.transform(calls, lambda c: X.calculate(c["op"], c["a"], c["b"]))
    checks = {
        "precedence_insensitive": F.col("final_answer") == F.col("naive_left_to_right_answer"),
        "parentheses": text.rlike(r"[()]"),
        "num_terms": shape["num_terms"] != F.col("num_terms"),
        "max_factors": shape["max_factors"] != F.col("max_factors_in_a_term"),
        "tier": X.tier(F.col("operation_count")) != F.col("tier"),
        "calls": F.size(calls) != F.col("operation_count"),
        "results": F.size(results) != F.size(calls),
        "values": results != worked,
        "links": ids != answered,
        "answer": ~transcripts.last_assistant(F.col(messages)).endswith(F.concat(F.lit(" "), X.number_text(F.col("final_answer")), F.lit("."))),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items())))


def ood_violations(domain: Column, e: Column) -> Column:
    """The invariant of its domain that an expression breaks, null if none."""
    n, values = F.size(e["operators"]), e["operands"]
    return (
        F.when((domain == "length") & ~n.between(6, 8), "length").when((domain == "negative") & ~F.exists(values, lambda x: x < 0), "negative")
        .when((domain == "float") & ~F.exists(values, lambda x: x != F.floor(x)), "float").when((domain == "id") & ~n.between(2, 5), "id")
    )


def replay(df: DataFrame) -> DataFrame:
    """Records scored on their own calls and without the last: valid_correct, and invalid_correct in turn, if all is well."""
    calls, n = transcripts.expected_calls(F.col("messages")), F.col("operation_count").cast("int")
    score = lambda c: trace.score(F.col("expression"), c, F.col("final_answer"), n, F.col("final_answer"))["outcome"]
    return df.select("id", score(calls).alias("whole"), score(F.slice(calls, F.lit(1), F.size(calls) - 1)).alias("cut"))


def inconsistent(df: DataFrame, rows: int, seed: int, step: int) -> DataFrame:
    """Artifacts of runs that aren't complete, of another seed, size or step, or whose prompts differ from the rest."""
    hashes = df.agg(F.min("prompt_hash").alias("__h"))
    bad = (F.col("status") != "complete") | (F.col("seed") != seed) | (F.col("rows") != rows) | (F.col("step") != step) | (F.col("prompt_hash") != F.col("__h"))
    return df.crossJoin(F.broadcast(hashes)).where(F.coalesce(bad, F.lit(True))).drop("__h")


def manifest(df: DataFrame, name: str, seed: int, sources: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row, manifest: JSON with name and seed of a mixture, its counts by stage and domain, and rows and fingerprint of each source (table, order column)."""
    cells = df.groupBy("stage", "domain").agg(F.count("*").alias("n"))
    whole = cells.agg(F.array_sort(F.collect_list(F.struct("stage", "domain", "n"))).alias("composition"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    prints = None
    for label, (table, order) in sorted((sources or {}).items()):
        one = hashing.fingerprint(table, order).select(F.struct(F.lit(label).alias("name"), F.col("n").alias("rows"), "fingerprint").alias("s"))
        prints = one if prints is None else prints.unionByName(one)
    if prints is None:
        body = F.struct(F.lit(name).alias("name"), F.lit(seed).alias("seed"), "rows", "composition")
        return whole.select(F.to_json(body).alias("manifest"))
    told = prints.agg(F.array_sort(F.collect_list("s")).alias("sources"))
    body = F.struct(F.lit(name).alias("name"), F.lit(seed).alias("seed"), "rows", "composition", "sources")
    return whole.join(told, F.lit(True)).select(F.to_json(body).alias("manifest"))
