"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are private-key blocks, known token formats, values that are assigned to a name, and long strings.
The forest judges each by its length, character transitions, dictionary coverage, path shape and neighbouring words. It is
trained from labelled findings: by default those of labelled_findings(), a seeded set of typical secrets and of typical
look-alikes (digests, ids, versions, card and serial numbers, paths, placeholders, plain words).
"""

from __future__ import annotations

import base64
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import RandomForest
from .common import small_batches

#: A finding counts as a secret from this score on.
THRESHOLD = 0.5
#: Characters before a candidate that are looked at.
BEFORE = 64
REPLACEMENT = "[SECRET]"
#: Names that announce secrets, and words that announce look-alikes.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "pass", "apikey", "api_key", "api-key", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "client_secret", "session", "signature", "webhook")
OTHER_NAMES = ("sha", "sha1", "sha256", "sha512", "md5", "commit", "hash", "checksum", "digest", "integrity", "uuid", "guid", "id", "version", "rev", "revision", "build", "etag", "serial", "isbn", "card", "order", "invoice", "phone", "account", "example", "test", "sample", "dummy", "placeholder", "fake", "trace", "request", "span", "file", "path", "url", "href", "src", "image")
WORDS = frozenset("the and for with that this from have not are was but all one out use get set new old key api test demo user name data file path main index page item list view code type value string number config default sample example change replace insert enter your here token secret password pass word admin root login account service server client host local public private static assets images image script style module package version build release src lib bin etc var home temp cache log logs doc docs http https www com org net html json yaml text book time date order invoice card phone street city state country red green blue one two three four five six seven eight nine ten master branch commit request response header footer content message error warning info debug true false null none undefined hello world lorem ipsum dolor sit amet tion ment able ness ing the der die das und ein les des que pour para con una".split())
PLACEHOLDER = re.compile(r"(?=example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234|abcd|\*\*\*\*|\.\.\.|\$\{|(.)\1{5})", re.I)
PATH = re.compile(r"\.[a-z]{2,4}\b|(?=//)")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")
#: The longest dictionary word at each place that has one.
WORD = re.compile(f"(?=({'|'.join(sorted((w for w in WORDS if 3 <= len(w) <= 10), key=lambda w: (-len(w), w)))}))")
#: Formats that are secrets by their shape. Fixed values.
KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
BLOCK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: What a key block without an end may hold: header lines, lines of base64 alone, and long base64 words.
BODY = re.compile(r"(?:\s*+(?:(?<=\n)[A-Za-z-]++: [^\n]*+(?=\n)|(?<=\n)[ \t]*+[A-Za-z0-9+/=]++[ \t]*+(?=[\r\n]|\Z)|[A-Za-z0-9+/=]{40,}+)|\\n)*+")
#: The first characters of a value that is assigned, behind what may hold a name; the value goes on to STOP.
ASSIGNED = re.compile(r"""(?<![\w.-])(?P<name>[\w.-]++)["']?[ \t]*+(?::=|=>|=|:)[ \t]*+(?P<quote>["'`]?)(?P<value>[^\s"'`,;]{8})""")
NAME = re.compile(r"(?<![\w-])[A-Za-z]")
STOP = re.compile(r"""[\s"'`,;]|\Z""")
NEXT = re.compile(r"[&#]|\Z")
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
DIGIT = re.compile(r"\d")
NAME_PARTS = re.compile(r"[A-Za-z]+\d*")


@dataclass(frozen=True)
class Finding:
    text: str
    start: int
    length: int
    kind: str
    assigned: bool
    quoted: bool

    @property
    def value(self) -> str:
        return self.text[self.start : self.start + self.length]

    @property
    def before(self) -> str:
        return self.text[max(0, self.start - BEFORE) : self.start]


def key_blocks(text: str) -> list[tuple[int, int]]:
    """[start, stop) of the private-key blocks: up to the end mark, or as far as the text looks like a key if the next mark is
    none of an end."""
    out, marks = [], [(m[1], m.start(), m.end()) for m in BLOCK.finditer(text)]
    for (kind, start, stop), after in zip(marks, [*marks[1:], None], strict=False):
        if kind == "BEGIN":
            out.append((start, after[2] if after and after[0] == "END" else BODY.match(text, stop).end()))
    return out


def candidates(text: str) -> list[Finding]:
    """All candidates of a whole text, in order; offsets are in code points.

    Known formats and assignments inside a value are candidates beside it, so candidates may overlap; one span is reported
    once. A value behind ? or & ends at the next & or #. Names and values have any length.
    """
    found: dict[tuple[int, int], tuple[str, bool]] = {}
    blocks = key_blocks(text)
    found |= dict.fromkeys(blocks, ("block", False))
    for m in KNOWN.finditer(text):
        found.setdefault(m.span(), ("known", False))
    values, names, at, run, edge = [], set(), 0, 0, -1
    while m := ASSIGNED.search(text, at):
        name = NAME.search(text, *m.span("name"))
        if not name:
            at = m.end("name")
            continue
        at = start = m.start("value")
        run = run if start < run else STOP.search(text, start).start()
        stop = run
        if text[name.start() - 1 : name.start()] in ("?", "&"):
            edge = edge if start <= edge else NEXT.search(text, start).start()
            stop = min(run, edge)
        if stop - start >= 16 or stop - start >= 8 and any(c.isalpha() for c in text[start:stop]):
            found.setdefault((start, stop), ("value", bool(m["quote"])))
            if not values or stop > values[-1][1]:
                values.append((start, stop))
            names.add((name.start(), m.end("name")))
    named, inside = sorted(names), sorted([*blocks, *values])
    i = j = 0
    for m in LONG.finditer(text):
        start, stop = m.span()
        while i < len(inside) and inside[i][1] <= start:
            i += 1
        while j < len(named) and named[j][1] <= start:
            j += 1
        within = i < len(inside) and inside[i][0] <= start and stop <= inside[i][1]
        # a name that isn't a string with digits is not looked at
        if not within and not (j < len(named) and named[j][0] <= start and stop <= named[j][1] and not DIGIT.search(m[0])):
            found.setdefault((start, stop), ("long", False))
    out, i = [], 0
    for (start, stop), (kind, quoted) in sorted(found.items()):
        while i < len(blocks) and blocks[i][1] <= start:
            i += 1
        if kind == "block" or not (i < len(blocks) and blocks[i][0] <= start):
            out.append(Finding(text, start, stop - start, kind, kind == "value", quoted))
    return out


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@cache
def _transitions() -> np.ndarray:
    """log-probability of each pair of letters in the words of the dictionary, smoothed."""
    counts = np.full((27, 27), 0.3)
    for w in WORDS:
        at = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in w]
        for a, b in zip(at, at[1:], strict=False):
            counts[a, b] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _covered(low: str, at: np.ndarray) -> list[int]:
    """For each place, the characters from there on in dictionary words of three letters or more, taken longest first from
    the left."""
    words = [(m.start(), len(m[1])) for m in WORD.finditer(low)]
    places, sums = [p for p, _ in words], [0] * (len(words) + 1)
    for i in range(len(words) - 1, -1, -1):
        sums[i] = words[i][1] + sums[bisect_left(places, sum(words[i]), i + 1)]
    return [sums[bisect_left(places, p)] for p in at]


def _values(text: str, starts: list[int], stop: int) -> np.ndarray:
    """The features of the whole values text[start:stop], made from sums over the longest of them."""
    first = min(starts)
    at = np.array(starts) - first
    v = text[first:stop]
    low = v.replace("\u0130", "i").lower()  # the only letter that has two in lower case
    n = len(v) - at
    codes, letters = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (v, low))
    letters = np.where((letters >= 97) & (letters <= 122), letters - 97, 26)
    chars, char = np.unique(codes, return_inverse=True)
    classes = np.array([_class(chr(c)) for c in chars])[char]
    of_class = [np.cumsum((classes == c)[::-1])[n - 1] for c in range(4)]
    hexes = np.cumsum(np.isin(codes, [ord(c) for c in "0123456789abcdefABCDEF"])[::-1])[n - 1]
    # how often a character is there from its place on
    back, counts = char[::-1], np.bincount(char)
    order, times = np.argsort(back, kind="stable"), np.empty(len(v), dtype=np.int64)
    times[order] = np.arange(len(v)) - (np.cumsum(counts) - counts)[back[order]] + 1
    shares = np.cumsum(times * np.log2(times) - (times - 1) * np.log2(np.maximum(times - 1, 1)))[n - 1]
    between = lambda x: np.concatenate([[0], np.cumsum(x[::-1])])[n - 1]
    paths = max((m.start() for m in PATH.finditer(v)), default=-1)
    fillers = max(max((m.start() for m in PLACEHOLDER.finditer(v)), default=-1), v.rfind("<", 0, max(0, v.rfind(">"))))
    return np.column_stack([
        np.log(n), np.round(np.log2(n) - shares / n, 9), np.cumsum(times == 1)[n - 1] / n,
        of_class[2] / n, of_class[1] / n, of_class[0] / n, of_class[3] / n,
        hexes == n, of_class[2] == n, np.isin(n, (32, 40, 64)) & (hexes == n),
        between(classes[1:] != classes[:-1]) / n, between(_transitions()[letters[:-1], letters[1:]]) / np.maximum(n - 1, 1), _covered(low, at) / n,
        np.cumsum((codes == 47)[::-1])[n - 1] / n, (paths >= at) | (codes[at] == 47), [bool(UUID.match(text, s, stop)) for s in starts], fillers >= at,
        np.maximum.accumulate(times)[n - 1] / n,
    ]).astype(float)


def _around(f: Finding) -> list[bool]:
    before = f.before
    names = [w.lower() for w in NAME_PARTS.findall(before.replace("_", " "))][-4:]
    last = names[-1] if names else ""
    return [f.assigned, f.quoted, any(x in SECRET_NAMES for x in names), last in SECRET_NAMES, any(x in OTHER_NAMES for x in names), last in OTHER_NAMES, f.kind == "known", before.rstrip().endswith(("/", "#", "@"))]


def featurize(found: list[Finding]) -> np.ndarray:
    """A row of features for each finding, from its whole value. Values inside one another end together and share their
    sums, so the work is in proportion to the texts."""
    ends: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(found):
        ends.setdefault((id(f.text), f.start + f.length), []).append(i)
    values = np.zeros((len(found), 18))
    for (_, stop), own in ends.items():
        values[own] = _values(found[own[0]].text, [found[i].start for i in own], stop)
    return np.column_stack([values[:, :-1], np.array([_around(f) for f in found], dtype=float), values[:, -1]])


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, int]]:
    """(text around one candidate, 1 for a secret or 0): a seeded set, half of each."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes = lambda k: pick("0123456789abcdef", k)
    mixed = string.ascii_letters + string.digits
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "de", "la", "ou", "ment", "ing", "ver", "sch", "que", "ion", "al", "st")) for _ in range(r.randint(1, 4)))
    secret = lambda: r.choice((lambda: hexes(r.choice((32, 40, 48, 64))), lambda: pick(mixed, r.randint(16, 64)), lambda: base64.b64encode(r.randbytes(r.randint(15, 48))).decode(), lambda: pick(mixed + "!@%^_-", r.randint(10, 24)), lambda: hexes(40)))()
    known = lambda: r.choice((lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(mixed, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24), lambda: "sk_live_" + pick(mixed, 24), lambda: "AIza" + pick(mixed, 35)))()

    phrase = lambda: "-".join(r.choice((word(), word().capitalize())) for _ in range(r.randint(3, 5)))

    def fill() -> str:
        t = " ".join(word() for _ in range(r.randint(0, 8)))
        return r.choice((t, t, t.capitalize(), t.upper()))

    def positive() -> str:
        if r.random() < 0.2:
            return f"{fill()} {known()} {fill()}"
        name = r.choice(("token", "token", "secret", "password", "api_key", "apikey", "auth_token", "client_secret", "aws_secret_access_key", "private_key", "access_token", "passwd", "session_key", "bearer", "key"))
        name = r.choice((name, name, name.upper(), "db_" + name, "my" + name.capitalize()))
        sign, q = r.choice((" = ", "=", ": ", ":", " := ", " => ")), r.choice(('"', '"', "'", ""))
        value = secret() if r.random() < 0.9 else r.choice((phrase, lambda: pick(string.ascii_letters, r.randint(12, 40))))()
        if value.isalpha() or "-" in value and not any(c.isdigit() for c in value):
            return f"{fill()} {name}{sign}{q or chr(34)}{value}{q or chr(34)} {fill()}"
        value = value.upper() if r.random() < 0.2 and name.isupper() else value
        if r.random() < 0.1:
            return f"{fill()} {name} {pick(mixed, 30)}1 {fill()}"
        return f"{fill()} {name}{sign}{q}{value}{q} {fill()}"

    def negative() -> str:
        kind = r.randrange(15)
        a, b = fill(), fill()
        digits = pick(string.digits, r.choice((16, 16, 16, 18, 20)))
        if kind <= 1:
            return f"{a} {digits}{r.choice(('', '!!', '.', ','))} {b}"
        if kind == 2:
            return f"{a} {r.choice(('commit', 'sha256', 'md5', 'checksum', 'etag', 'rev', 'digest'))}{r.choice((' ', ': ', '=', ' = '))}{hexes(r.choice((32, 40, 64)))} {b}"
        if kind == 3:
            return f"{a} {r.choice(('id', 'uuid', 'request_id', 'trace'))}{r.choice((' ', ': ', '='))}{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)} {b}"
        if kind == 4:
            return f"{a} /{word()}/{word()}/{word()}{r.randint(1, 99)}/{word()}_{r.randint(1, 9)}.{r.choice(('html', 'png', 'js'))} {b}"
        if kind == 5:
            return f"{a} {r.choice(('token', 'password', 'api_key', 'secret'))} = \"{r.choice(('your_token_here_1', 'xxxxxxxxxxxxxxxx1', 'changeme1234', 'example-token-123', '<insert 1234>', '********1', 'abcd1234abcd1234'))}\" {b}"
        if kind == 6:
            return f"{a} {r.choice(('version', 'release', 'build'))}{r.choice((' ', '=', ': '))}{word()}-{r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}-{word()}-{word()}2 {b}"
        if kind == 7:
            return f"{a} {word()}{word()}{word()}{word()}{word()}{r.randint(1, 999)} {b}"
        if kind == 8:
            return f"{a} {r.choice(('color', 'width', 'page', 'ref', 'time', 'date', 'order', 'invoice', 'phone'))}{r.choice(('=', ': '))}{word()}{r.randint(10**6, 10**9)} {b}"
        if kind == 9:
            return f"{a} https://{word()}.example.com/{word()}/{r.randint(1, 10**9)}?{word()}={word()}{r.randint(1, 99)}&{word()}=1 {b}"
        if kind == 10:
            return f"{a} {word()}-{word()}-{word()}-{word()}-{r.randint(1, 10**5)} {b}"
        long = "".join(word() for _ in range(4))
        if kind == 11:
            return f"{a} {r.choice((long, long.capitalize(), long.upper()))} {b}"
        if kind == 12:
            return f"{a} {r.choice(('_', '-', '/')).join(word() for _ in range(r.randint(4, 6)))} {b}"
        if kind == 13:  # a word behind a colon
            return f"{a} {r.choice((word(), 'note', 'password', 'token', 'key', 'access', 'author', 'title'))}: {r.choice((long[:12], long.capitalize()))} {b}"
        return f"{a} {r.choice((word(), 'see', 'url', 'href'))}{r.choice(('=', ': ', ' '))}https://{word()}.org/{word()}/{word()}-{word()} {b}"

    return [(positive(), 1) if i % 2 else (negative(), 0) for i in range(n)]


def train(findings: list[tuple[str, int]] | None = None, trees: int = 50) -> RandomForest:
    """A forest from labelled findings, each a text whose candidates all bear its label."""
    x, y = [], []
    for text, label in findings if findings is not None else labelled_findings():
        own = candidates(text)
        x += own
        y += [label] * len(own)
    return RandomForest().fit(featurize(x), np.array(y), trees=trees)


def judge(found: list[Finding], forest: RandomForest) -> np.ndarray:
    """Scores of findings; private-key blocks need no judgement."""
    scores, judged = np.ones(len(found)), [i for i, f in enumerate(found) if f.kind != "block"]
    if judged:
        scores[judged] = forest.predict(featurize([found[i] for i in judged]))
    return scores


def scan(docs: DataFrame, forest: RandomForest, threshold: float = THRESHOLD, rid: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, start, length, kind, score, is_secret): one row for each candidate of every whole text.

    Null and empty texts, and an empty table, have none; long texts are scanned whole. Repeated rows are reported each, and
    null ids kept. start and length are in code points.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, found = [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = candidates(t or "")
                rids += [r] * len(own)
                found += own
            scores = judge(found, forest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array([f.start for f in found], pa.int64()), pa.array([f.length for f in found], pa.int64()), pa.array([f.kind for f in found], pa.string()), pa.array(scores, pa.float64()), pa.array(scores >= threshold, pa.bool_())],
                ["rid", "start", "length", "kind", "score", "is_secret"],
            )

    return docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).mapInArrow(run, "rid bigint, start bigint, length bigint, kind string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: RandomForest, threshold: float = THRESHOLD, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret in `text` replaced; all rows and columns stay. `chars`, if there, is counted anew for
    texts that change. A null text stays null, an empty one empty; long texts are read whole, and repeated rows change alike."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text)
    count = names.index(chars) if chars in names else None

    def clean(t: str | None) -> str | None:
        found = candidates(t) if t else []
        spans: list[list[int]] = []  # overlapping secrets go as one
        for f, s in zip(found, judge(found, forest), strict=True):
            if s >= threshold:
                if spans and f.start < spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], f.start + f.length)
                else:
                    spans.append([f.start, f.start + f.length])
        for start, stop in reversed(spans):
            t = t[:start] + REPLACEMENT + t[stop:]
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, pa.string())
            if count is not None:
                was = columns[count].to_pylist()
                columns[count] = pa.array([w if a == b else len(b) for w, a, b in zip(was, old, new, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train()).withColumnRenamed("rid", "doc_id")
