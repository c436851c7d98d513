"""Arbitration of close choices by a language model behind an interface; none is built in."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V
from ..plans.tables import joined
from .asking import SECONDS, WINDOW, Ask
from .asking import asked as calls
from .candidates import SCOPES

#: The margin under which a choice is close; candidates shown; characters of a context.
CLOSE, SHOWN, WIDTH = 0.1, 40, 110


def prompts(seeds: DataFrame, candidates: DataFrame, products: DataFrame) -> DataFrame:
    """(page_id, prompt) of pages whose margin is close and whose product is known: candidates, greatest first, with their best context."""
    close = joined(seeds.where(F.col("margin") < CLOSE).select("page_id"), products.where("product <> ''").select("page_id", "product"), "page_id")
    worth = F.transform("contexts", lambda x: F.struct(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), x["scope"]).alias("w"), x["scope"].alias("scope"), F.substring(x["text"], 1, WIDTH).alias("text")))
    rows = joined(candidates, close, "page_id").withColumn("best", F.array_min(worth))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc(V.prompt_key(F.col("version"))), "version"))).where(F.col("k") <= SHOWN)
    line = F.concat(F.col("version"), F.lit(" ["), F.col("best.scope"), F.lit("] "), F.col("best.text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n")
    one = rows.groupBy("page_id", "product").agg(listed.alias("lines"))
    return one.select("page_id", F.concat(F.lit("Which of these is the current version of "), "product", F.lit("? Answer with the version only.\n"), "lines").alias("prompt"))


def answered(asked: DataFrame, ask: Ask | Sequence[Ask] | None, window: int = WINDOW, seconds: float = SECONDS, tasks: int | None = None) -> DataFrame:
    """(page_id, answer, error): versions of two numbers or more in the answers of ask; none without one, or where it fails.

    Several functions are asked one after the other, until one names a version; window,
    seconds and tasks as for asking.asked().
    """
    if ask is None:
        return asked.select("page_id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))
    raw = calls(asked, ask, "prompt", window, seconds, tasks, lambda x: bool(re.search(r"[0-9]+\.[0-9]", x)))
    return raw.select("page_id", T.answer_version(F.coalesce("answer", F.lit(""))).alias("answer"), "error")


def settled(selected: DataFrame, answers: DataFrame) -> DataFrame:
    """selected (page_id, version, margin) with answers in place of close choices, and confidence."""
    rows = joined(selected, answers.select("page_id", "answer"), "page_id", "left")
    sure: Column = (F.col("margin") >= CLOSE) | F.col("answer").isNotNull()
    return rows.select("page_id", F.coalesce("answer", "version").alias("version"), "margin", F.when(sure, "high").otherwise("low").alias("confidence"))


def button_links(pages: DataFrame, k: int = 3) -> DataFrame:
    """(page_id, rank, href, text, score): links most like download buttons: 2 for a download word, 1 for a platform, up to 1 for length; 2 at least."""
    anchors = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)
    rows = pages.select("page_id", F.posexplode(anchors).alias("i", "a"))
    rows = rows.select("page_id", "i", F.regexp_extract("a", r"""(?i)href=["']([^"']*)["']""", 1).alias("href"), T.clean_text(F.col("a")).alias("text"))
    said = F.concat_ws(" ", "text", "href")
    score = F.when(said.rlike("(?i)download|install|get it|free trial|下载"), 2.0).otherwise(0.0) + F.when(said.rlike("(?i)windows|mac|linux|ios|android"), 1.0).otherwise(0.0) + F.least(F.length("text") / 20, F.lit(1.0))
    ranked = rows.withColumn("score", score).where("score >= 2").withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "i")))
    return ranked.where(F.col("rank") <= k).select("page_id", "rank", "href", "text", F.round("score", 6).alias("score"))


def state_versions(states: DataFrame, depth: int = 3) -> DataFrame:
    """(page_id, key, value): values of keys with "version" in JSON states (page_id, json), to a depth, 30 characters at most."""
    import json

    def walk(x, level):
        if isinstance(x, dict) and level < depth:
            for k, v in x.items():
                if "version" in k.lower() and isinstance(v, str | int | float) and not isinstance(v, bool) and len(str(v)) <= 30:
                    yield k, str(v)
                yield from walk(v, level + 1)

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b["page_id"], b["json"], strict=True):
                try:
                    rows += [(i, k, v) for k, v in walk(json.loads(text), 0)]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["page_id", "key", "value"]).astype({"page_id": "int64"})

    return states.select(F.col("page_id").cast("long"), "json").mapInPandas(run, "page_id long, key string, value string")
