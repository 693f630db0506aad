"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed (sha256 of the text). The ledger holds which blobs have been
scanned under which rule version, and the findings of those that have any; a run scans each unseen pair of blob and
rule version once and joins the findings back to all paths, copies included.

Defined cases: a null text counts as empty; an empty text has no spans and the sha256 of the empty string; repeated
rows and copies get the same findings; null ids are kept; an empty table gives no rows; other columns are not read.
Texts are read whole, and spans are code points with the end excluded.

Only blob addresses are grouped, with map-side sums. Where a run adds little to what was scanned before (a tenth of its
blobs are unseen, and FEW at most) their addresses go to where the texts are read, and nothing moves; else texts move once, by blob and the id of the version to be scanned, and rows that
repeat an id and a text are reduced to one before they move, so a blob that holds a third of all rows doesn't gather in
one task. Findings come back the same way: by broadcast up to FEW rows and FEW_BYTES, else by a join on salted blobs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.llm.common import Scratch, read_table, small_batches
from cairn.llm.textnum import LOWER, Texts, table, text_map

#: kind, pattern, least length of the group, group, strings of which one must occur (in lower case) for a match.
#: The first three are the base kinds.
RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 12, 2, [b"passw", b"secret", b"token", b"apikey", b"api_key"]),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0, [b"akia"]),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0, None),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 34, 0, [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"]),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 30, 0, [b"eyj"]),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 15, 0, [b"xox"]),
    ("pem", re.compile(r"-----BEGIN(?:\x20[A-Z0-9]+)*\x20PRIVATE\x20KEY-----"), 1, 0, [b"private key"]),
]
KINDS = [r[0] for r in RULES]
BASE_KINDS = 3
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, n, g) for k, p, n, g, _ in RULES]).encode()).hexdigest()[:16]
HEX = table((48, 57), (97, 102))
FEW, FEW_BYTES, SALTS = 50_000, 8 << 20, 16
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
NO_SHA = hashlib.sha256(b"").hexdigest()


def find(text: str, kinds: range | list[int] = range(len(RULES))) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the findings of one text, in order."""
    out = []
    for k in kinds:
        _, pattern, least, group, _ = RULES[k]
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def candidates(t: Texts) -> dict[int, list[int]]:
    """For each text that can have findings, the kinds to look for: a byte search that misses no match."""
    out: dict[int, list[int]] = {}
    low = t.buf.tobytes().translate(LOWER.tobytes())
    for k, (_, _, least, _, needles) in enumerate(RULES):
        if needles is None:
            s, e, doc = t.spans(HEX)
            docs = set(doc[e - s >= least].tolist())
        else:
            docs = set()
            for needle in needles:
                at = low.find(needle)
                while at >= 0:
                    d = int(np.searchsorted(t.end, at, side="left"))
                    docs.add(d)
                    at = low.find(needle, int(t.end[d]) + 1)
        for d in docs:
            out.setdefault(d, []).append(k)
    return out


def scan_block(t: Texts) -> dict:
    counts = np.zeros((BASE_KINDS, t.n), dtype=np.int64)
    sha, spans = [NO_SHA] * t.n, [""] * t.n
    for d, kinds in candidates(t).items():
        found = find(t.raw(d).decode("utf-8", "replace"), kinds)
        base = [x for x in found if x[1] < BASE_KINDS]
        for x in base:
            counts[x[1], d] += 1
        sha[d] = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        spans[d] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
    return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": pa.array(sha), "spans": pa.array(spans)}


class Ledger:
    """Tables `blobs` (blob, rule_version) and `findings` (blob, rule_version, findings) under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, ddl: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], ddl)

    def blobs(self) -> DataFrame:
        return self._read("blobs", "blob binary, rule_version string")

    def findings(self) -> DataFrame:
        return self._read("findings", f"blob binary, rule_version string, {FINDINGS}")

    def update(self, versions: DataFrame, paths: DataFrame, rule_version: str, scratch: Scratch) -> DataFrame:
        """Scan the blobs of versions (id, text, blob), whose addresses are paths (id, blob), that the ledger has not under
        this rule version; returns (blob, findings) of all blobs that have any."""
        at = F.xxhash64("id").alias("at")  # never null, unlike the id
        done = self.blobs().filter(F.col("rule_version") == rule_version)
        first = paths.groupBy("blob", at).agg(F.count("*").alias("n")).groupBy("blob").agg(F.min(F.struct("at", "n")).alias("v"))
        all_blobs = Observation()
        first = first.observe(all_blobs, F.count(F.lit(1)).alias("n"))
        unseen = scratch.write(first.join(done, "blob", "left_anti").select("blob", "v.at", "v.n"), "unseen")
        rows, most = unseen.agg(F.count("*"), F.max("n")).head()
        if rows:
            texts, wanted = versions.select(at, "blob", "text"), unseen.select("at", "blob")
            once = (lambda df: df) if most == 1 else (lambda df: df.dropDuplicates(["at", "blob"]))
            if rows <= min(FEW, all_blobs.get["n"] // 10):
                texts = once(texts.join(F.broadcast(wanted), ["at", "blob"], "left_semi"))
            else:
                texts = once(texts).join(wanted.hint("shuffle_hash"), ["at", "blob"], "left_semi")
            found = text_map(texts, ["blob"], "text", FINDINGS, scan_block).filter("spans <> ''").dropDuplicates(["blob"])
            found.withColumn("rule_version", F.lit(rule_version)).select("blob", "rule_version", *FINDING_COLS).write.mode("append").parquet(f"{self.root}/findings")
            # last, so that a run that broke off is repeated rather than trusted
            unseen.select("blob", F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{self.root}/blobs")
        # a retried run can leave a blob's findings twice
        known = self.findings().filter(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])
        return scratch.write(known, "known")

    def scan(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan what is unseen, add it to the ledger, and return (id, blob, findings) of every version."""
        scratch = Scratch(self.spark, "ledger")
        addressed = versions.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), address(text_col).alias("blob"))
        paths = scratch.write(addressed.select("id", "blob"), "paths")
        return with_findings(paths, self.update(addressed, paths, rule_version, scratch)).withColumnRenamed("id", id_col)


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def address(col: str) -> Column:
    return F.unhex(F.sha2(text_of(col).cast("binary"), 256))


def with_findings(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (blob, ...) with the findings known of their blobs, null for those that have none."""
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).head()
    if n <= FEW and size <= FEW_BYTES:
        return rows.join(F.broadcast(known), "blob", "left")
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["blob", "salt"], "left").drop("salt")


FINDING_COLS = [f.split()[0] for f in FINDINGS.split(", ")]
DEFAULTS = {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": NO_SHA, "spans": ""}


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, through a new ledger; see the module for the defined cases."""
    ledger = Ledger(spark, Scratch(spark, "secrets").root)
    return ledger.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *DEFAULTS).na.fill(DEFAULTS)


def redacted(text: str, listed: str) -> str:
    """The text with its spans (kind:start:end, comma-joined) replaced by `[secret]`; what overlaps is replaced once."""
    parts, at = [], 0
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in listed.split(",")):
        if s >= at:
            parts += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redact(rows: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """The rows with the text's spans replaced; batches without spans pass as they are."""
    schema, names = rows.schema, rows.columns
    arrow = to_arrow_schema(schema)
    ti, si = names.index(text_col), names.index(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.cast(f.type) for c, f in zip(b.columns, arrow, strict=True)]
            listed = b.column(si).to_pylist()
            if any(listed):
                texts = b.column(ti).to_pylist()
                cols[ti] = pa.array([redacted(t, x) if x else t for t, x in zip(texts, listed, strict=True)], arrow.field(ti).type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by `[secret]` (n_chars follows the text)."""
    names, scratch = docs.columns, Scratch(spark, "secrets-stage")
    # renamed on the way in and out, lest the documents have columns of the names used here
    inner = docs.toDF(*[f"d{i}" for i in range(len(names))])
    text = f"d{names.index('text')}"
    versions = inner.select(F.col(f"d{names.index('doc_id')}").alias("id"), text_of(text).alias("text"), address(text).alias("blob"))
    paths = scratch.write(versions.select("id", "blob"), "paths")
    known = Ledger(spark, scratch.path("ledger")).update(versions, paths, RULE_VERSION, scratch)
    rows = with_findings(inner.withColumn("blob", address(text)), known.select("blob", "spans"))
    out = redact(rows.select(*inner.columns, F.coalesce("spans", F.lit("")).alias("spans")), text, "spans")
    if "n_chars" in names:
        n = f"d{names.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("spans") != "", F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*inner.columns).toDF(*names)


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLES: dict[str, str] = {}
