"""Secret scans: fixed patterns, and character Markov models for secrets that no pattern names.

The patterns give the base spans. Besides, every run of 16 or more token characters that touches no
base span is scored under two first-order character models, one of random strings and one of
ordinary identifiers; a run whose log-likelihood ratio is high enough is a span of kind ``markov``.

Both models are trained from labelled samples: what the patterns match, together with strings made
from digests, is random; tokens of the sampled documents outside all matches are ordinary, and so are identifiers made
of words (in camel and snake case, paths, option names, dates and UUIDs), separator lines, repeated characters, alphabets and rows of
keys; sampled words count in capitals too. What repeats with a period of four characters or less tells nothing new and adds nothing to a ratio.
The sample is bounded: the ``sample_docs`` texts with
the lowest hash, and of each label the ``sample_tokens`` tokens with the lowest hash, up to ``sample_chars`` characters each.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; spans
are sorted by start, then by kind; repeated rows each get a row; columns other than the text pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bpe import text_slices

KINDS = ("assign", "access", "hex", "markov")
_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # as [0-9a-f]+ of 16 or more: a run is always taken whole
RUN = r"[A-Za-z0-9+/_=-]{16,}"
_assign, _access, _hex, _run = map(re.compile, (ASSIGN, ACCESS, HEX, RUN))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
#: Lengths of patterns whose repetition speaks for no secret.
PERIODS = (1, 2, 3, 4)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of all pattern matches."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end()) for m in _hex.finditer(text)]
    return out


def _transitions(strings: list[str], prior: float) -> np.ndarray:
    """Log-probabilities of the next character given the last; the row beyond the alphabet is the start.

    Each row leans on the shares of single characters, evened out by half, as if seen ``4`` times: pairs without a
    sample are then neither a coin toss nor a proof."""
    n = len(ALPHABET)
    counts = np.zeros((n + 1, n))
    for s in strings:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        c = c[c < n]
        if len(c):
            np.add.at(counts, (np.append(n, c[:-1]), c), 1)
    single = counts.sum(axis=0) + prior
    counts += 2 * single / single.sum() + 2 / n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def made_strings(n: int = 3000) -> list[str]:
    """Random strings in the usual alphabets (base64, hexadecimal, base32), from digests of numbers."""
    raw = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    forms = (lambda r: base64.urlsafe_b64encode(r).decode().rstrip("="), lambda r: base64.b64encode(r).decode().rstrip("="), lambda r: r.hex()[:40], lambda r: base64.b32encode(r).decode().rstrip("=")[:32])
    return [forms[i % 4](r) for i, r in enumerate(raw)]


#: Labelled sample, ordinary side: words that names in programs and files are made of.
NAME_WORDS = (
    "abstract account action adapter address admin agent api app archive array asset async attribute author auto backend background bar base batch bean binary body boot branch bridge buffer build builder "
    "button by byte cache call category channel char check child class clean client clone cluster code column command comment commit common component config connection console constant container content "
    "context control cookie copy core count create current custom data database date debug decode default delete depth detail device dialog digest direct disk display document domain download driver dynamic "
    "edit element email empty enable encode end engine entity entry enum environment error event exception export external factory field file filter first flag float flow folder font format frame from function "
    "gateway get global graph group handler hash header height helper hidden home host html http icon id image import index info init input insert instance int interface internal invalid is item iterator java "
    "job json key label language last layer layout length level library license limit line link list listener load local lock log login long loop machine main make manager map mapper master match max member "
    "memory menu message meta method min mock mode model module mouse name network new next node null number object offset on open operation option order output owner package page panel parameter parent parse "
    "parser password path pattern payment permission phone pixel plugin point policy pool popup port position post prefix private process processor product profile project property protocol provider proxy public "
    "query queue random range rate read record reference refresh register registry remote remove render report request reset resource response result role root route router row rule run runtime sample save scale "
    "schedule schema screen script search section security select send sequence server service session set setting shared show simple singleton size socket sort source spring stack start state static status step "
    "storage store stream string style submit support sync system tab table tag target task template test text theme thread time title to token toolbar tools trace transaction transform tree type unit update "
    "upload url user util valid validate value variable vector version view visible web width window with word worker wrapper write xml zone"
).split()


def made_names(words: list[str], n: int = 6000, upper: bool = False) -> list[str]:
    """Ordinary identifiers of two to six words, picked by digests of numbers: every form in turn, or those in capitals."""
    out = []
    for i in range(n):
        d = hashlib.sha256(f"name {i}".encode()).digest()
        picked = [words[int.from_bytes(d[2 * k : 2 * k + 2]) % len(words)].lower() for k in range(2 + d[30] % 5)]
        caps, number, hexes = "".join(w.capitalize() for w in picked), str(d[29] % 100), d.hex()
        forms = (
            caps, picked[0] + caps[len(picked[0]) :], "_".join(picked), "_".join(picked).upper(), "-".join(picked), "/" + "/".join(picked), "/".join(picked) + "_" + number, caps + number,
            "--" + "-".join(picked) + "=" + number, "_".join(picked) + "_v" + number, f"{picked[0]}_20{d[28] % 90 + 10}-{d[27] % 12 + 1:02d}-{d[26] % 28 + 1:02d}", f"{hexes[:8]}-{hexes[8:12]}-4{hexes[13:16]}-a{hexes[17:20]}-{hexes[20:32]}",
        )
        out.append("-_/"[i % 3].join(picked).upper() if upper else forms[i % len(forms)])
    return out


def made_sequences(copies: int = 40) -> list[str]:
    """Ordinary strings that no word is in: repeated characters and pairs of separators, alphabets, digits and rows of keys, both ways."""
    rows = ["abcdefghijklmnopqrstuvwxyz", "0123456789", "1234567890", "qwertyuiopasdfghjklzxcvbnm", "qwertzuiopasdfghjklyxcvbnm", "azertyuiopqsdfghjklmwxcvbn"]
    rows += [r.upper() for r in rows if r.isalpha()] + ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    pairs = [a + b for a in "+/_=-" for b in "+/_=-"]
    return [*rows, *(r[::-1] for r in rows)] * copies + [c * 24 for c in ALPHABET] + [p * 12 for p in pairs]


def fit(random: list[str], ordinary: list[str]) -> np.ndarray:
    """Table of log-likelihood ratios, random over ordinary, by last and next character."""
    return _transitions(random, 1.0) - _transitions(ordinary, 0.5)


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = 4000, sample_tokens: int = 20000, sample_chars: int = 200) -> np.ndarray:
    """Train the ratio table on a bounded sample of ``docs`` and on made strings of both labels."""
    texts = docs.select(F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h")).filter("_t is not null")
    edge = texts.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    if edge is None:
        return fit(made_strings(), made_names(NAME_WORDS) + made_sequences())
    chosen = texts.filter(F.col("_h") <= edge).dropDuplicates(["_h"])
    values = F.concat(
        F.filter(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 12),
        F.filter(F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)), lambda x: F.length(x) >= 18),
        F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))

    def sampled(column) -> list[str]:
        one = chosen.select(F.explode(column).alias("s")).select(F.substring("s", 1, sample_chars).alias("s")).distinct()
        return [r[0] for r in one.orderBy(F.xxhash64("s"), "s").limit(sample_tokens).collect()]

    ordinary = sampled(plain)
    words = sorted({w for w in ordinary if w.isalpha() and w.isascii() and len(w) <= 12}, key=lambda w: hashlib.sha256(w.encode()).digest())[: len(NAME_WORDS)]
    capitals = made_names(words, 4000, upper=True) if words else []
    return fit(sampled(values) + made_strings(), ordinary + capitals + made_sequences() + made_names(NAME_WORDS) + made_names(words or NAME_WORDS, 2000))


def _ratios(runs: list[str], table: np.ndarray) -> np.ndarray:
    """Summed log-likelihood ratio of each run; the second of two characters that repeat what came a period before counts nothing."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    code = _CODE[np.frombuffer("".join(runs).encode(), np.uint8)]
    first = np.cumsum(sizes) - sizes
    last = np.append(len(ALPHABET), code[:-1])
    last[first] = len(ALPHABET)
    gain, place, again = table[last, code], np.arange(len(code)) - np.repeat(first, sizes), np.zeros(len(code), bool)
    for p in PERIODS:
        same = code[p:] == code[:-p]
        again[p + 1 :] |= same[1:] & same[:-1] & (place[p + 1 :] > p)
    return np.add.reduceat(np.where(again, np.minimum(gain, 0), gain), first)


def scan(texts: list[str], table: np.ndarray, least_mean: float, least_sum: float) -> list[list[tuple[int, int, int, float | None]]]:
    """Spans of each text, sorted by start and kind."""
    out, runs, where = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        taken = sorted(spans, key=lambda s: s[1])
        k, reach = 0, -1
        for m in _run.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] < b:
                reach = max(reach, taken[k][2])
                k += 1
            if reach <= a:
                runs.append(m.group())
                where.append((i, a, b))
        out.append([(kind, a, b, None) for kind, a, b in spans])
    if runs:
        for (i, a, b), r in zip(where, _ratios(runs, table).tolist(), strict=True):
            if r >= least_sum and r >= least_mean * (b - a):
                out[i].append((3, a, b, r))
    return [sorted(s, key=lambda x: (x[1], x[0])) for s in out]


def find_secrets(docs: DataFrame, table: np.ndarray, text_col: str = "text", least_mean: float = 0.7, least_sum: float = 18.0, redact: str | None = None) -> DataFrame:
    """``docs`` with an array ``spans``. The text column is dropped, or with ``redact`` returned with each span replaced by it."""
    others = [c for c in docs.columns if c not in (text_col, "spans")]
    given = docs.select(F.struct(*others).alias("_row") if others else F.lit(None).cast("int").alias("_row"), F.col(text_col).alias("_text"))
    fields = [given.schema["_row"], T.StructField("_spans", SPANS)] + ([T.StructField("_text", T.StringType())] if redact is not None else [])
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))

    def clean(text: str | None, spans: list) -> str | None:
        if not spans:
            return text
        parts, at = [], 0
        for _, a, b, _ in spans:
            if b > at:
                parts += [text[at : max(a, at)], redact if a >= at else ""]
                at = b
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices([t or "" for t in texts]):
                found = scan([t or "" for t in texts[lo:hi]], table, least_mean, least_sum)
                spans = pa.array([[{"kind": KINDS[k], "start": a, "end": e, "ratio": r} for k, a, e, r in s] for s in found], item)
                columns = [b.column(0).slice(lo, hi - lo), spans]
                if redact is not None:
                    columns.append(pa.array(list(map(clean, texts[lo:hi], found)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "_spans", "_text"][: len(columns)])

    out = given.mapInArrow(run, T.StructType(fields))
    picked = [F.col("_row").getField(c).alias(c) for c in others] + [F.col("_spans").alias("spans")]
    return out.select(*picked, *([F.col("_text").alias(text_col)] if redact is not None else []))


def span_columns() -> list:
    """Counts by kind, the digest of the base spans, and all spans as one string."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return [
        *map(count, KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    ]
