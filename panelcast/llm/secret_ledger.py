"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed (SHA-256 of its text). The ledger, a
Parquet folder, holds one row for each (blob, rule, rule version) that has been scanned,
with the spans found (also when there are none). A run scans only the pairs that the ledger
lacks, each blob once however many paths carry it, appends them, and joins findings back
to all paths. A rule whose version changes is scanned anew; the others are not.

Texts are reduced to one copy a blob before they are shuffled. Appending is a Parquet
commit; rows are a function of their key, so a repeated append does no harm: readers take
each key once.

Null text is the empty blob. Repeated rows and several versions of one path each get their
row. A null path is kept. Only the named columns are read. Spans are in code points, the
end exclusive; matches of one rule do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import narrow
from panelcast.session import scratch_path

LEDGER = "blob string, rule string, version string, spans array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``needles``: lower-case strings of which a matching text holds at least one (none: always searched)."""

    name: str
    version: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    needles: tuple[str, ...] = ()

    def finder(self) -> Callable[[str, str], list[tuple[int, int]]]:
        compiled = re.compile(self.pattern, self.flags)

        def find(text: str, low: str) -> list[tuple[int, int]]:
            if self.needles and not any(x in low for x in self.needles):
                return []
            return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]

        return find


#: The kinds of the contract, in its order. A run of 24 or more is a maximal run, so the count may stand in the pattern.
BASE = (
    Rule("assign", "1", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 0, 20, ("akia",)),
    Rule("hex", "1", r"[0-9a-f]{24,}", 0, 0, 24),
)
#: The key from its BEGIN line to the matching END line (none other may begin before it); without one, to the end of the header fields and base64 lines.
_PRIVATE_KEY = (
    r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----"
    r"|(?:(?:\s|\\[rn])+(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*|[A-Za-z0-9+/=]{32,}|[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n\\\"']|\Z))))*)"
)
#: Further public credential formats.
EXTRA = (
    Rule("private_key", "1.1", _PRIVATE_KEY, 0, 0, 0, ("private key-----",)),
    Rule("jwt", "1", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, 0, ("eyj",)),
    Rule("url_password", "1.1", r"[a-z][a-z0-9+.-]{1,19}://[^\x00-\x20/:@]*:[^\x00-\x20/:@]+@", 0, 0, 0, ("://",)),
)
RULES = BASE + EXTRA


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Each (blob, rule, version) once; an absent folder is an empty ledger."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger at ``path`` has not seen of these texts and append it."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # map-side, one copy of each blob in a task; the shuffle carries no more
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.concat_ws("/", F.lit(r.name), F.lit(r.version)) for r in rules])
    seen = ledger(spark, path).groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", "version")).alias("seen"))
    todo = blobs.join(seen, "blob", "left").select(
        "blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")
    ).where(F.size("todo") > 0)
    todo.mapInArrow(_scanner(rules), LEDGER).write.mode("append").parquet(path)


def _scanner(rules: tuple[Rule, ...]):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        finders = {f"{r.name}/{r.version}": (r, r.finder()) for r in rules}
        for b in batches:
            rows: dict[str, list] = {"blob": [], "rule": [], "version": [], "spans": []}
            for blob, text, todo in zip(b.column("blob").to_pylist(), b.column("text"), b.column("todo").to_pylist(), strict=True):
                text = text.as_py()
                low = text.lower()
                for key in todo:
                    rule, find = finders[key]
                    for k, v in (("blob", blob), ("rule", rule.name), ("version", rule.version), ("spans", [{"start": s, "end": e} for s, e in find(text, low)])):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict({
                "blob": pa.array(rows["blob"], pa.string()), "rule": pa.array(rows["rule"], pa.string()), "version": pa.array(rows["version"], pa.string()),
                "spans": pa.array(rows["spans"], pa.list_(span)),
            })

    return scan


def by_blob(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, found)``: all spans of the current rule versions by start, then rule in the order given; a row for each scanned blob."""
    order = spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version string, ord int")
    rows = ledger(spark, path).join(F.broadcast(order), ["rule", "version"])  # one row a rule
    found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("ord").alias("ord"), s["end"].alias("end"), F.col("rule").alias("kind")))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(found))).alias("found"))


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, blob, found)`` for every row of ``docs``; the ledger is updated first (a new one if no path is given)."""
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "secret-ledger")
    update(docs, path, rules, text_col)
    paths = narrow(docs, id=id_col, text=text_col).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    found = by_blob(spark, path, rules)
    return paths.join(found, "blob").select(F.col("id").alias(id_col), "blob", "found")


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text."""
    base = [r.name for r in BASE]
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return scanned.select(
        F.col(f"`{id_col}`"), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(as_text(of(*base)), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one); a null text stays null."""
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "secret-ledger")
    update(docs, path, rules, text_col)
    found = by_blob(spark, path, rules).where(F.size("found") > 0).select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    text = F.col(f"`{text_col}`")
    joined = docs.join(found, F.sha2(F.coalesce(text, F.lit("")), 256) == found["_blob"], "left")
    # walk the sorted spans: clean stretches so far, and where the last span ended
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("end"))

    def step(acc, s):
        stretch = F.substring(text, (acc["end"] + 1).cast("int"), (s["start"] - acc["end"]).cast("int"))
        apart = s["start"] >= acc["end"]
        return F.struct(
            F.when(apart, F.concat(acc["parts"], F.array(stretch))).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["end"], s["end"]).alias("end")
        )

    cleaned = F.aggregate(
        F.col("_found"), start, step,
        lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substring(text, (acc["end"] + 1).cast("int"), F.length(text)))), mark),
    )
    return joined.withColumn(text_col, F.when(F.col("_found").isNull(), text).otherwise(cleaned)).drop("_blob", "_found")
