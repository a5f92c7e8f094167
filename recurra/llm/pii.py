r"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base kinds are found by their patterns, leftmost and non-overlapping, then checked (octets, Luhn, digit counts); they
always stay. The field reads the text's tokens that hold a digit or an at sign, in unbroken runs: every segment of at
most MAX_TOKENS of them is scored as a whole span of each kind (digit counts, separators, octets, Luhn, hexadecimal
length, the words before), and dynamic programming over ends chooses boundaries and kinds together. Other tokens can't
be inside a segment, so they are outside by definition. Spans of the field that touch a base span give way to it.

The weights are trained on the driver by conditional likelihood, from the base spans and assigned secrets of a bounded
sample (labelled by rule; SAMPLE_ROWS different pieces of at most PIECE characters, of all pieces of all texts those of
smallest hash) and from written examples of further forms; the model is a few kB and broadcast. Every text is searched
by itself, whole: no shuffle.

Defined results: null counts as empty text and has no spans; repeated rows are searched each; an empty table gives an
empty table (and a field trained on the written examples alone); columns beside the text pass through `redact`
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import textnum as tn
from recurra.llm.scratch import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_TOKENS = 4
SAMPLE_ROWS, PIECE = 400, 2000

_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Each digit run is entered at its first digit only, and taken whole: the same matches as without, in linear time.
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the pattern: a local part is the whole run before its at sign, as far as the last match allows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while d := _DIGITS.search(text, at):
        if m := _IP.match(text, d.start()):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append(m.span())
            at = m.end()
        else:
            at = d.end()
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = ((k, f(text)) for k, f in zip(BASE, (emails, ips, cards, phones)))
    return [(k, a, z) for k, spans in found for a, z in spans]


# ---- the field

_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]")
_LEFT, _RIGHT = "\"'<[{|*#$%&,;:!?=`", "\"'>)]}|*#$%&,;:!?.=`"
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_CODE = re.compile(r"[A-Za-z0-9_/+=-]+\Z")
_MAIL = re.compile(r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z")
CUES = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api_key", "apikey", "bearer", "passphrase"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telephone", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit"),
    "ip": ("ip", "host", "addr", "address", "server"),
    "email": ("mail", "email", "e-mail", "contact"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
_NAMES = (
    ["bias"]
    + [f"digits{k}" for k in range(8)]
    + ["at", "mail", "plus", "paren", "dash", "space", "dot", "slash", "colon", "letters", "only", "octets", "groups3", "luhn", "hex", "code", "mixed", "quoted", "assigned"]
    + [f"size{k}" for k in range(5)]
    + [f"tokens{k}" for k in range(1, MAX_TOKENS + 1)]
    + [f"cue_{k}" for k in CUES]
)
_AT_NAME = {n: i for i, n in enumerate(_NAMES)}


def token_runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring tokens with a digit or at sign: start and end of what is left without outer punctuation, and the words before the run's tokens."""
    out: list[list[tuple[int, int, str]]] = []
    last, before = -2, ("", "")
    for k, m in enumerate(_TOKEN.finditer(text)):
        t = m[0]
        if _TRIGGER.search(t):
            core = t.lstrip(_LEFT)
            a = m.start() + len(t) - len(core)
            z = a + max(1, len(core.rstrip(_RIGHT)))
            if last != k - 1:
                out.append([])
            out[-1].append((a, z, " ".join(before)))
            last = k
        before = (before[1], t)
    return out


def features(text: str, start: int, end: int, n_tokens: int, before: str) -> list[int]:
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    f = ["bias", f"digits{sum(n > k for k in (0, 3, 6, 9, 12, 15, 19))}", f"size{sum(len(s) > k for k in (4, 8, 16, 32))}", f"tokens{n_tokens}"]
    if "@" in s:
        f.append("at")
        if _MAIL.match(s):
            f.append("mail")
    for c, name in (("(", "paren"), ("-", "dash"), (" ", "space"), (".", "dot"), ("/", "slash"), (":", "colon")):
        if c in s:
            f.append(name)
    if s.startswith("+"):
        f.append("plus")
    letters = any(c.isalpha() for c in s)
    f.append("letters" if letters else "only")
    groups = s.split(".")
    if all(g.isdigit() for g in groups):
        if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups):
            f.append("octets")
        elif len(groups) == 3:
            f.append("groups3")
    if 13 <= n <= 19 and not letters and luhn(digits):
        f.append("luhn")
    if len(s) >= 16:
        if _HEX.match(s):
            f.append("hex")
        if _CODE.match(s):
            f.append("code")
            if letters and n >= 3:
                f.append("mixed")
    if start and text[start - 1] in "\"'`":
        f.append("quoted")
    if before.rstrip("\"'` ").endswith(("=", ":")) or text[max(0, start - 2) : start].rstrip("\"'` ").endswith("="):
        f.append("assigned")
    for w in re.split(r"[^a-z_-]+", before.lower()):
        if w in _CUE:
            f.append(f"cue_{_CUE[w]}")
    return [_AT_NAME[x] for x in dict.fromkeys(f)]


def segments(text: str, run: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(first, last token) of every segment of the run, and its features."""
    spans, found = [], []
    for j in range(len(run)):
        for i in range(max(0, j - MAX_TOKENS + 1), j + 1):
            spans.append((i, j))
            found.append(features(text, run[i][0], run[j][1], j - i + 1, run[i][2]))
    return spans, found


class Field:
    def __init__(self, weights: np.ndarray):
        self.weights = weights  # feature x kind

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's spans."""
        out = []
        for run in token_runs(text):
            spans, found = segments(text, run)
            best, back, k = [0.0], [], 0
            for j in range(len(run)):
                top, how = best[j], None
                while k < len(spans) and spans[k][1] == j:
                    s = self.weights[found[k]].sum(0)
                    y = int(s.argmax())
                    if best[spans[k][0]] + s[y] > top:
                        top, how = best[spans[k][0]] + s[y], (spans[k][0], y)
                    k += 1
                best.append(top)
                back.append(how)
            j, mine = len(run) - 1, []
            while j >= 0:
                if back[j] is None:
                    j -= 1
                else:
                    i, y = back[j]
                    mine.append((KINDS[y], run[i][0], run[j][1]))
                    j = i - 1
            out += mine[::-1]
        return out


def train_field(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, ridge: float = 0.02, rate: float = 0.5) -> Field:
    """Gradient ascent (AdaGrad) on the conditional likelihood of the examples' spans."""
    data = []
    for text, gold in examples:
        at = {(a, z): KINDS.index(k) for k, a, z in gold}
        for run in token_runs(text):
            spans, found = segments(text, run)
            x = np.zeros((len(spans), len(_NAMES)))
            for k, f in enumerate(found):
                x[k, f] = 1
            y = np.zeros((len(spans), len(KINDS)))
            for k, (i, j) in enumerate(spans):
                if (kind := at.get((run[i][0], run[j][1]))) is not None:
                    y[k, kind] = 1
            data.append((len(run), spans, x, y))
    w, seen = np.zeros((len(_NAMES), len(KINDS))), np.full((len(_NAMES), len(KINDS)), 1e-6)
    for _ in range(rounds):
        grad = -ridge * w
        for n, spans, x, y in data:
            score = x @ w
            whole = np.logaddexp.reduce(score, 1)
            a = np.full(n + 1, -np.inf)
            a[0] = 0
            k = 0
            for j in range(n):
                a[j + 1] = a[j]
                while k < len(spans) and spans[k][1] == j:
                    a[j + 1] = np.logaddexp(a[j + 1], a[spans[k][0]] + whole[k])
                    k += 1
            b = np.full(n + 1, -np.inf)
            b[n] = 0
            by_start: list[list[int]] = [[] for _ in range(n)]
            for k, (i, _) in enumerate(spans):
                by_start[i].append(k)
            for i in range(n - 1, -1, -1):
                b[i] = b[i + 1]
                for k in by_start[i]:
                    b[i] = np.logaddexp(b[i], b[spans[k][1] + 1] + whole[k])
            first, last = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
            grad += x.T @ (y - np.exp((a[first] + b[last + 1] - a[n])[:, None] + score))
        seen += grad**2
        w += rate * grad / np.sqrt(seen)
    return Field(w)


_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|bearer)\b[\x20]?[=:]?[\x20]?[\"']?([A-Za-z0-9_/+-]{16,})")
#: Written examples of forms that the base patterns don't know, [kind|span], and of numbers that are none of the kinds.
WRITTEN = """\
call [phone|(415) 555-0132] today
tel [phone|212-555-0198] or later
Phone: [phone|020 7946 0958] now
fax [phone|555-010-4477] in town
reach me at [email|jo.d@mail.example.org] soon
ip [ip|10.0.0.7] seen
password: [secret|hunter2hunter2hunter2] was set
api_key = "[secret|sk9f8a7d6c5b4a3f2e1d0c9b8a]" in it
secret = [secret|Zx81Qw72Er63Ty54Ui45Op36] there
bearer [secret|a81f6c2b9d3e4f50617283940a1b2c3d] sent
card [card|4111 1111 1111 1111] on file
visa [card|4012888888881881] kept
version 2.10.3 of 2024 is out
on 2024-05-17 at 12:30 we had 3 of 14
it costs 1,299.00 or 1299 in 2 parts
chapter 12 section 4.5 page 331
order 100234567 shipped in 5 days
ISBN 978-3-16-148410-0 printed 1998
build 3f2a91c of 7 files
call 7 people at 9:15 on 03/04/2021
the score was 21-14 in game 3
room 4.12 holds 250 in 10 rows
year 1999 to 2003 and 2005-2010
id 5550132 in list 88
1234567890123456 is a serial number of 16
see 10.1000/182 and 3.14159265
user@ 12 things at 5 @ 3 each
1.2.3.4.5 is a heading, 300.400.500.600 too
"""


def written() -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for line in WRITTEN.splitlines():
        text, gold, done = "", [], 0
        for m in re.finditer(r"\[(\w+)\|([^\]]+)\]", line):
            text += line[done : m.start()]
            gold.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            done = m.end()
        out.append((text + line[done:], gold))
    return out


def ruled(text: str) -> list[tuple[str, int, int]]:
    """Spans labelled by rule: the base ones, and values assigned to a secret's name that hold a digit."""
    base = base_spans(text)
    secrets = [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if re.search("[0-9]", m[1])]
    return base + [s for s in secrets if not _touches(s, base)]


def _touches(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(span[1] < z and a < span[2] for _, a, z in others)


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans; by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, z) for _, a, z in base)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([z for _, z in taken], np.int64)) if taken else starts
    added = []
    for k, a, z in field.decode(text):
        i = int(np.searchsorted(starts, z, "left"))
        if not (i and ends[i - 1] > a):
            added.append((k, a, z))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> Field:
    """From the written examples and `rows` pieces of the texts that hold a digit or at sign, by smallest hash; equal pieces count once."""
    t = docs.select(F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))).alias("t")).where(F.col("t").rlike("[0-9@]"))
    t = t.withColumn("h", F.xxhash64("t"))
    last = t.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # hashes alone move first; then only the chosen pieces
    pieces = [] if last is None else [r[0] for r in t.where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").select("t").collect()]
    whole = [p.partition(" ")[2].rpartition(" ")[0] if len(p) == PIECE else p for p in pieces]  # without the tokens that the cuts go through
    return train_field([(x, ruled(x)) for x in whole] + 10 * written())


def _searched(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows and texts that hold a digit or at sign; no kind has a span elsewhere."""
    trigger = tn.byte_set((48, 57), (64, 64))
    for i, j, data, off in tn.blocks(column):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(trigger[data], out=c[1:])
        for k in np.flatnonzero(c[off[1:]] > c[off[:-1]]):
            yield i + int(k), data[off[k] : off[k + 1]].tobytes().decode()


SPANS = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: one row per row of docs, spans in code points, end exclusive."""
    small_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": z} for k, a, z in spans]
        for b in batches:
            base, spans = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for k, text in _searched(b.column(1)):
                x, y = all_spans(text, shared.value)
                base[k], spans[k] = as_rows(x), as_rows(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _LIST), pa.array(spans, _LIST)], ["doc_id", "base", "spans"])

    return own.mapInArrow(tn.released(search), f"doc_id {own.dtypes[0][1]}, {SPANS}")


def redact(docs: DataFrame, field: Field, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span (overlapping ones together) replaced by its kind in brackets, and `chars_col` recounted there."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, count = names.index(text_col), names.index(chars_col) if chars_col in names else None
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new: dict[int, str] = {}
            for k, text in _searched(b.column(at)):
                spans = sorted((a, -z, kind) for kind, a, z in all_spans(text, shared.value)[1])
                if spans:
                    out, done = [], 0
                    for a, z, kind in spans:
                        if a >= done:
                            out += [text[done:a], f"[{kind.upper()}]"]
                        done = max(done, -z)
                    new[k] = "".join([*out, text[done:]])
            if new:
                columns = list(b.columns)
                texts = columns[at].to_pylist()
                for k, t in new.items():
                    texts[k] = t
                columns[at] = pa.array(texts, columns[at].type)
                if count is not None:
                    counts = columns[count].to_pylist()
                    for k, t in new.items():
                        counts[k] = len(t)
                    columns[count] = pa.array(counts, columns[count].type)
                b = pa.RecordBatch.from_arrays(columns, names)
            yield b

    return docs.mapInArrow(tn.released(clean), docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_pii(docs, train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [count(k) for k in BASE]
    n_spans = F.size("spans").cast("long").alias("n_spans")
    n_secret = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return found.select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), n_spans, n_secret)
