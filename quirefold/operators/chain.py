"""A chain of cleaners over documents: failures stay with their stage, figures come from the same pass.

A stage is a column expression, or a Python function of one text that may
raise and may return counts beside its text.  A stage that fails, or gives no
text, passes its input on, and the stage's entry in ``trail`` says so.
Python stages that follow each other run in one Arrow pass.

``observe`` adds the stages' totals to whatever action is run on the result;
``report`` gives them as rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quirefold.functions.pieces import arrow_udf

STEP = "struct<stage:string,status:string,changed:boolean,chars_in:long,chars_out:long,ms:double,error:string,counts:map<string,long>>"
_ARROW = pa.struct(
    [
        ("text", pa.string()),
        ("trail", pa.list_(pa.struct([("stage", pa.string()), ("status", pa.string()), ("changed", pa.bool_()), ("chars_in", pa.int64()), ("chars_out", pa.int64()), ("ms", pa.float64()), ("error", pa.string()), ("counts", pa.map_(pa.string(), pa.int64()))]))),
    ]
)


@dataclass(frozen=True)
class Stage:
    """status in the trail: ok, empty (no text came back), failed, or skipped (a kind it does not take, or a null text)."""

    name: str
    expression: Callable[[Column], Column] | None = None
    function: Callable[[str], str | None | tuple[str | None, dict[str, int]]] | None = None
    #: Kinds of documents it takes; None: all.
    kinds: tuple[int, ...] | None = None

    def __post_init__(self):
        if (self.expression is None) == (self.function is None):
            raise ValueError(f"{self.name}: give an expression or a function")


def _in_jvm(df: DataFrame, stages: list[Stage], text: str, kind: str | None) -> DataFrame:
    """One nested expression: each stage's input and output are bound once, however often its step names them."""
    at = F.array(F.struct(F.col(text).alias("text"), F.col("trail").alias("trail")))

    def tried(stage: Stage):
        def one(x: Column) -> Column:
            takes = x["text"].isNotNull()
            if stage.kinds is not None and kind is not None:
                takes = takes & F.coalesce(F.col(kind).isin(*stage.kinds), F.lit(False))
            return F.struct(x["text"].alias("old"), x["trail"].alias("trail"), takes.alias("takes"), F.when(takes, stage.expression(x["text"])).alias("new"))

        return one

    def noted(stage: Stage):
        def one(x: Column) -> Column:
            now = F.coalesce(x["new"], x["old"])
            step = F.struct(
                F.lit(stage.name).alias("stage"),
                F.when(~x["takes"], "skipped").when(x["new"].isNull(), "empty").otherwise("ok").alias("status"),
                F.coalesce(x["new"] != x["old"], F.lit(False)).alias("changed"),
                F.length(x["old"]).cast("long").alias("chars_in"),
                F.length(now).cast("long").alias("chars_out"),
                F.lit(None).cast("double").alias("ms"),
                F.lit(None).cast("string").alias("error"),
                F.create_map().cast("map<string,long>").alias("counts"),
            )
            return F.struct(now.alias("text"), F.concat(x["trail"], F.array(step)).alias("trail"))

        return one

    for stage in stages:
        at = F.transform(F.transform(at, tried(stage)), noted(stage))
    df = df.withColumn("_done", at[0])
    return df.withColumns({"trail": F.col("_done.trail"), text: F.col("_done.text")}).drop("_done")


def _applied(stages: list[Stage], text: str, kind: int | None, with_kind: bool) -> dict:
    trail = []
    for s in stages:
        step = {"stage": s.name, "status": "ok", "changed": False, "chars_in": None if text is None else len(text), "ms": 0.0, "error": None, "counts": []}
        if text is None or (with_kind and s.kinds is not None and kind not in s.kinds):
            step["status"] = "skipped"
        else:
            began = time.perf_counter()
            try:
                new = s.function(text)
                new, counts = new if isinstance(new, tuple) else (new, {})
                step["counts"] = list(counts.items())
                if new is None:
                    step["status"] = "empty"
                else:
                    step["changed"], text = new != text, new
            except Exception as e:
                step |= {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:160]}"}
            step["ms"] = (time.perf_counter() - began) * 1000
        step["chars_out"] = None if text is None else len(text)
        trail.append(step)
    return {"text": text, "trail": trail}


def _in_python(df: DataFrame, stages: list[Stage], text: str, kind: str | None) -> DataFrame:
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), kinds.to_pylist(), strict=True)
        return pa.array([_applied(stages, t, k, kind is not None) for t, k in pairs], _ARROW)

    df = df.withColumn("_run", arrow_udf(run, f"struct<text:string,trail:array<{STEP}>>")(F.col(text), F.col(kind).cast("int") if kind else F.lit(0)))
    return df.withColumns({"trail": F.concat("trail", "_run.trail"), text: F.col("_run.text")}).drop("_run")


def run(df: DataFrame, stages: list[Stage], text: str = "content", kind: str | None = None) -> DataFrame:
    """``df`` with the cleaned ``text`` and ``trail``, one entry a stage in order."""
    if len({s.name for s in stages}) < len(stages):
        raise ValueError("stages need names of their own")
    df = df.withColumn("trail", F.array().cast(f"array<{STEP}>"))
    for python, group in groupby(stages, lambda s: s.function is not None):
        df = (_in_python if python else _in_jvm)(df, list(group), text, kind)
    return df


def observe(df: DataFrame, stages: list[Stage], observation: Observation) -> DataFrame:
    """Totals of each stage, taken while the rows go by; read them with ``figures`` after an action."""
    totals = [F.count("*").alias("rows")]
    for i, s in enumerate(stages):
        step = F.col("trail")[i]
        totals += [F.count_if(step["changed"]).alias(f"{s.name}.changed"), F.sum(step["ms"]).alias(f"{s.name}.ms")]
        totals += [F.count_if(step["status"] == w).alias(f"{s.name}.{w}") for w in ("failed", "skipped", "empty")]
    return df.observe(observation, *totals)


def figures(observation: Observation, stages: list[Stage]) -> list[dict]:
    got = observation.get
    return [{"stage": s.name, "rows": got["rows"]} | {w: got[f"{s.name}.{w}"] for w in ("changed", "failed", "skipped", "empty", "ms")} for s in stages]


def report(df: DataFrame) -> DataFrame:
    """(position, stage, rows, changed, failed, skipped, empty, chars_in, chars_out, ms): the same as rows, added up before the shuffle."""
    s = df.select(F.posexplode("trail").alias("position", "s"))
    is_ = lambda w: F.count_if(F.col("s.status") == w).alias(w)
    return s.groupBy("position", F.col("s.stage").alias("stage")).agg(
        F.count("*").alias("rows"), F.count_if("s.changed").alias("changed"), is_("failed"), is_("skipped"), is_("empty"),
        F.sum("s.chars_in").alias("chars_in"), F.sum("s.chars_out").alias("chars_out"), F.sum("s.ms").alias("ms"),
    )


def counts(df: DataFrame) -> DataFrame:
    """(stage, name, n): what the stages' functions counted."""
    s = df.select(F.explode("trail").alias("s")).select(F.col("s.stage").alias("stage"), F.explode("s.counts").alias("name", "n"))
    return s.groupBy("stage", "name").agg(F.sum("n").alias("n"))
