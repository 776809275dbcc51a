"""P10 with any number of signatures: an automaton of all of them reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x

#: Bytes of signatures in one automaton; its nodes take some 60 times as much memory in a task.
BYTES_A_PASS = 2_000_000


def table(spark, rules) -> DataFrame:
    """(lgo, signature, priority) of a plan's rules."""
    rows = [(lgo, s, i) for i, (lgo, own) in enumerate(rules.signatures) for s in own]
    return spark.createDataFrame(rows, "lgo string, signature string, priority long")


def blocks(signatures: DataFrame, most: int = BYTES_A_PASS) -> Iterator[list[tuple[str, int]]]:
    """The distinct lower-cased signatures with their least priority, dealt by hash into lists of about so many bytes at most, one after another."""
    own = signatures.select(F.lower("signature").alias("s"), "priority").filter("s is not null and priority is not null").groupBy("s").agg(F.min("priority").alias("p"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    passes = max(1, -(-(size.b + size.n) // most))
    for i in range(passes if size.n else 0):
        yield [(r.s, r.p) for r in own.filter(F.pmod(F.xxhash64("s"), F.lit(passes)) == i).collect()]


def _first(told):
    """Of a batch of lower-cased texts, the least priority of the signatures that each holds."""
    made: list = []  # the task's automaton

    def run(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            automaton, always = ahocorasick.Automaton(), None
            for s, p in told.value:
                if s:
                    automaton.add_word(s, p)
                else:
                    always = p  # an empty signature is in any text
            automaton.make_automaton()
            made.append((automaton if len(automaton) else None, always))
        automaton, always = made[0]
        out = []
        for t in texts.to_pylist():
            found = [] if always is None else [always]
            if automaton is not None and t:
                found += {p for _, p in automaton.iter(t)}
            out.append(min(found, default=None))
        return pa.array(out, pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")


def fingerprints(documents: DataFrame, signatures: DataFrame, most: int = BYTES_A_PASS) -> DataFrame:
    """P10, JN9: documents(text, ...) with lgo: the software of least priority one of whose signatures(lgo, signature, priority) the text contains in any case, or null.

    Signatures are counted, and go to the tasks in automata of about most bytes each; a text is read once by each, whatever
    the number of signatures. A priority belongs to one software; if rows disagree, the least name counts. A null text is
    empty, and an empty signature is in every text.
    """
    spark = documents.sparkSession
    low, best = F.lower(x.text(F.col("text"))), []
    for part in blocks(signatures, most):
        best.append(_first(spark.sparkContext.broadcast(part))(low))
    priority = F.lit(None).cast("long") if not best else best[0] if len(best) == 1 else F.least(*best)
    names = signatures.filter("signature is not null and priority is not null").groupBy(F.col("priority").cast("long").alias("__priority")).agg(F.min("lgo").alias("lgo"))
    found = documents.withColumn("__priority", priority)
    return found.join(names, "__priority", "left").drop("__priority")
