"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score. DataFrame functions only.

Base kinds are taken as stated, leftmost and without overlaps within a kind; a proposal that fails its check is dropped
and not retried: email, ip (parts to 255), card (12-19 digits, Luhn), phone (9-15 digits). The method adds kinds whose
proposals need more evidence: iban (mod-97), ssn, key (prefixes that issuers of keys and tokens document), secret (a long
run of letters and digits) and password (a value set beside such a name); the last two need a digit and a letter. Their
score is a base by kind, for matches that passed their check, and more by a context word within ``NEAR`` characters on
either side; spans that reach ``THRESHOLD`` are reported. Context never removes a base span, whose scores are reported all
the same.

The patterns are written with possessive repeats and with a look behind at the run's start (or the previous match's end),
which changes no match and keeps the time linear in the text however long a run of digits or letters is.

Places are code points, end exclusive. Cases: null and empty texts have no spans; a text may hold any number of spans;
doc_id may be null or repeat, rows alike give rows alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

NEAR, THRESHOLD = 40, 0.5
E = r"A-Za-z0-9._%+-"
#: kind: pattern, in the order in which kinds are listed
PATTERNS = {
    "email": rf"(?:(?<![{E}])|\G)[{E}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}+|gh[opsru]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
    "password": r"(?i)(?<![a-z])(?:passw(?:or)?d|passphrase|pwd|secret|api[_ -]?key)[\"']?[\x20\t]?[:=][\x20\t]?[\"']?[^\s\"']{6,}+",
}
#: What a text must hold before a pattern is worth trying: every match holds it.
HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE = ["email", "ip", "card", "phone"]
#: kind: score of a match that passed its check; a context word adds 0.3
SCORE = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.6, "ssn": 0.3, "key": 0.8, "secret": 0.3, "password": 0.6}
CONTEXT = {
    "email": "mail|contact|address|write",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|payment|pay",
    "phone": r"phone|call|\btel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|tax",
    "key": "key|token|secret",
    "secret": r"token|secret|passw|api.?key|\bkey\b|auth|credential|bearer",
    "password": "login|user|account",
}
NO_SPANS = "cast(array() as array<struct<start: int, end: int, rank: int, kind: string, score: double>>)"


def running_sums(x: Column) -> Column:
    """x[0], x[0] + x[1], ... of an array of ints, in blocks so that long arrays aren't copied for each element."""
    size = 64

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v)))

    def whole(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: v + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: sums(F.slice(x, i * size + 1, size)))
    return F.when(F.size(x) > 0, let(blocks, whole)).otherwise(F.array().cast("array<int>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the last digit of a string of digits is its check digit."""

    def value(i: Column) -> Column:
        twice = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(m: Column) -> Column:
    plain = F.translate(m, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c)
    return F.aggregate(F.split(moved, "(?<=.)(?=.)"), F.lit(0), lambda a, c: F.when(code(c) < 58, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind in ("secret", "password"):
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return mod97(m) if kind == "iban" else F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """The spans of one kind: places are sums of the lengths of matches and of what lies between them."""
    none = F.expr(NO_SPANS)

    def placed(matches: Column) -> Column:
        between = F.split(text, PATTERNS[kind], -1)

        def built(steps: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = F.get(steps, i)
                around = F.lower(F.substring(text, F.greatest(start - NEAR + 1, F.lit(1)), F.length(m) + F.least(start, F.lit(NEAR)) + NEAR))
                score = F.lit(SCORE[kind]) + F.when(around.rlike(CONTEXT[kind]), 0.3).otherwise(0.0)
                kept = F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(list(PATTERNS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), score.alias("score"))
                return F.when(valid(kind, m), kept)

            return F.filter(F.transform(matches, span), lambda x: x.isNotNull() if kind in BASE else x["score"] >= THRESHOLD)

        lengths = let(between, lambda b: F.transform(matches, lambda m, i: F.length(F.get(b, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)))
        return F.when(F.size(matches) > 0, let(running_sums(lengths), built)).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(HINT[kind])), found).otherwise(none) if kind in HINT else found


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, end, rank, kind, score), by start, then kind as listed, of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.array_sort(F.concat(*(kind_spans(F.col("text"), kind) for kind in PATTERNS)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE), F.sha2(text(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
