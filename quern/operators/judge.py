"""A judge that is called: questions of a query in one request, batched in tasks, tokens counted, failures kept to their queries.

A judge is made once in each task by `make()`: a function from a list of requests to a list of replies in their order. A
request is {"query_id", "request", "questions": [{"key", "kind", "prompt", "options": [{"option", "text"}]}]}; a reply
{"tokens": int, "answers": {key: {option: p}}}, or an exception for a request that failed. `kind` is "choice" (one of the options
or no_match) or "noul" (the probability that the prompt is so, under the option "yes").

Defined results: a request that raises, a reply without an answer to each question and a judge that fails as a whole give an error
and no answers for the queries concerned, which are decision_unavailable; all others stand. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import clipped

UNAVAILABLE, DECIDED, YES = "decision_unavailable", "decided", "yes"
AT_ONCE = 32
Judge = Callable[[list[dict]], list[dict | Exception]]


def choices(grouped: DataFrame, prompt: str, most_chars: int = 420) -> DataFrame:
    """A choice question for each group of candidates (query_id, group_id, option, text): as many options as a group has."""
    options = F.array_sort(F.collect_list(F.struct("option", clipped(F.col("text"), most_chars).alias("text"))))
    each = grouped.groupBy("query_id", "group_id").agg(options.alias("options"))
    return each.select("query_id", F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("key"), F.lit("choice").alias("kind"), F.lit(prompt).alias("prompt"), "options")


def nouls(rows: DataFrame, key: Column, prompt: Column) -> DataFrame:
    """A yes-or-no question for each row (query_id, ...)."""
    none = F.array().cast("array<struct<option:string,text:string>>")
    return rows.select("query_id", key.alias("key"), F.lit("noul").alias("kind"), prompt.alias("prompt"), none.alias("options"))


def called(questions: DataFrame, make: Callable[[], Judge], per_request: int = 64) -> DataFrame:
    """query_id, request, tokens, error, answers (map of key to map of option to probability) of each request. A query's
    questions go together, `per_request` of them at most. Write the result before it is read twice: each reading calls the judge."""
    nth = F.floor((F.row_number().over(W.partitionBy("query_id").orderBy("key")) - 1) / per_request).cast("int")
    asked = questions.withColumn("request", nth).groupBy("query_id", "request").agg(F.collect_list(F.struct("key", "kind", "prompt", "options")).alias("questions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for pdf in batches:
            rows = pdf.to_dict("records")
            for start in range(0, len(rows), AT_ONCE):
                part = [{"query_id": r["query_id"], "request": r["request"], "questions": [{**q, "options": list(q["options"])} for q in r["questions"]]} for r in rows[start : start + AT_ONCE]]
                try:
                    replies = judge(part)
                except Exception as e:  # noqa: BLE001  # whatever it is, these have no decision
                    replies = [e] * len(part)
                out = []
                for request, reply in zip(part, [*replies, *[ValueError("no reply")] * len(part)]):
                    failed = reply if isinstance(reply, Exception) else None
                    if failed is None and any(q["key"] not in reply["answers"] for q in request["questions"]):
                        failed = ValueError("a question without an answer")
                    answers = {} if failed else {k: {o: float(p) for o, p in v.items()} for k, v in reply["answers"].items()}
                    out.append((request["query_id"], request["request"], 0 if failed else int(reply["tokens"]), f"{type(failed).__name__}: {failed}" if failed else None, answers))
                yield pd.DataFrame(out, columns=["query_id", "request", "tokens", "error", "answers"])

    return asked.mapInPandas(run, "query_id long, request int, tokens long, error string, answers map<string,map<string,double>>")


def answers(replies: DataFrame) -> DataFrame:
    """query_id, key, option, p of the requests that were answered, of queries without a failed one."""
    good = F.max(F.col("error").isNotNull()).over(W.partitionBy("query_id"))
    rows = replies.withColumn("_bad", good).where(~F.col("_bad"))
    return rows.select("query_id", F.explode("answers").alias("key", "own")).select("query_id", "key", F.explode("own").alias("option", "p"))


def totals(replies: DataFrame) -> DataFrame:
    """query_id, requests, tokens, failed, status: what a query has cost, and whether it can be decided."""
    failed = F.count_if(F.col("error").isNotNull())
    out = replies.groupBy("query_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), failed.alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, UNAVAILABLE).otherwise(DECIDED))
