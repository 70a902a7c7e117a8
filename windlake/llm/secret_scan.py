"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that they label.

The patterns' matches are labelled credentials, by kind. For each format of a kind (a fixed prefix, or the classes of
characters it has), a prefix tree of a bounded sample of its credentials is folded into a probabilistic automaton by
merging states whose next-symbol frequencies are compatible (Hoeffding bound) as far as enough strings reach them; the
lengths of its strings are the format's too. Every candidate string of a text is then scored by its likelihood, for each symbol, under
each kind's automaton against plain text; those that fit a format better than text are added as spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, small_batches, text_or_empty

#: Fixed by the contract; letters of the first in either case, ASCII only.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate: a maximal run of credential characters, or what base spans leave of it, from the shortest base length up.
SHORTEST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
ADDED = "grammar"

SAMPLE_PER_KIND = 3_000  # credentials that an automaton is learnt from, those with the smallest hashes
ALPHA = 0.05
NEVER = math.log(1e-3)  # a step from a symbol that plain text doesn't have
MARGIN = 0.8  # nats for each symbol over plain text; numbers of 6 digits reach 0.72, longer ones less


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the patterns' matches, leftmost and not overlapping within a kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def symbol(c: str) -> str:
    """The automata's alphabet: classes of characters, so that formats are learnt and not values."""
    if c.isdigit():
        return "0"
    if c.islower():
        return "a" if c <= "f" else "g"
    return "A" if c.isupper() else c


#: What symbol() makes of the bytes of ASCII text.
SYMBOLS = bytes(ord(symbol(chr(b))) if b < 128 else b for b in range(256))
ASCII_SYMBOLS = {b: SYMBOLS[b] for b in range(128)}
WORD = re.compile(r"[A-Za-z0-9+/_.=-]{4,}")


EDGE = "\n"  # stands before and after a word


def plain_words(text: str, base: list[tuple[str, int, int, str]]) -> list[str]:
    """The text's words, those that touch a base span aside."""
    if base:
        return [m[0] for m in WORD.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e, _ in base)]
    return WORD.findall(text)


def symbol_pairs(words: list[str]) -> Counter:
    """How often each symbol follows another in the words, their edges included."""
    codes = np.frombuffer(f"{EDGE}{EDGE.join(words)}{EDGE}".encode().translate(SYMBOLS), np.uint8).astype(np.int64)
    n = np.bincount(codes[:-1] * 128 + codes[1:])
    return Counter({chr(b // 128) + chr(b % 128): int(n[b]) for b in n.nonzero()[0] if b != ord(EDGE) * 129})


LEAST = 20  # strings that a state must have seen for its frequencies to say anything
PREFIX, PREFIX_SHARE = 3, 0.5  # so many characters, each after the first the next one of half of the strings that got so far


def prefixes(strings: list[str]) -> list[str]:
    """The fixed prefixes of a sample, longest first: strings that begin alike go on alike, as random ones don't."""
    found, work = [], [("", strings)]
    while work:
        prefix, some = work.pop()
        after: dict[str, list[str]] = defaultdict(list)
        for s in some:
            if len(s) > len(prefix):
                after[s[len(prefix)]].append(s)
        grown = [(prefix + c, x) for c, x in after.items() if len(x) >= LEAST and (not prefix or len(x) >= PREFIX_SHARE * len(some))]
        if len(prefix) >= PREFIX and not grown:
            found.append(prefix)
        work += grown
    return sorted(found, key=lambda p: (-len(p), p))


def shape(s: str) -> str:
    """Which classes of characters a string has: strings of one format mostly agree."""
    return "".join(sorted({"a" if c == "g" else c for c in map(symbol, s)}))


class Automaton:
    """States with the counts of their next symbols and of strings that end there, and the lengths of all strings."""

    def __init__(self, strings: list[str] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.end: list[int] = [0]
        self.lengths = Counter(map(len, strings))
        self.states = 1
        for s in strings:
            at = 0
            for c in map(symbol, s):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.count.append(Counter()), self.end.append(0)
                at = self.next[at][c]
            self.end[at] += 1

    def total(self, q: int) -> int:
        return self.end[q] + self.count[q].total()

    def _close(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) < math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, q: int, r: int) -> bool:
        """Whether two states, and those after them that have seen enough, could have the same frequencies of symbols. Where strings
        end is left to their lengths."""
        work, seen = [(q, r)], set()
        while work:
            q, r = work.pop()
            n, m = self.count[q].total(), self.count[r].total()
            if n < LEAST or m < LEAST or (q, r) in seen:
                continue
            seen.add((q, r))
            for c in self.count[q].keys() | self.count[r].keys():
                if not self._close(self.count[q][c], n, self.count[r][c], m):
                    return False
                if c in self.next[q] and c in self.next[r]:
                    work.append((self.next[q][c], self.next[r][c]))
        return True

    def fold(self, q: int, r: int) -> None:
        """Adds the tree below r to q."""
        work = [(q, r)]
        while work:
            q, r = work.pop()
            self.end[q] += self.end[r]
            self.count[q] += self.count[r]
            for c, child in self.next[r].items():
                if c in self.next[q]:
                    work.append((self.next[q][c], child))
                else:
                    self.next[q][c] = child

    def merge_states(self) -> Automaton:
        """Red states are settled. Each state next to them, those that most strings reach first, is merged into the compatible red one
        that saw most, or becomes red. A state that too few strings reach proves nothing: it goes to where its symbol
        mostly leads from red states, or stays with its parent."""
        red, in_red = [0], {0}
        while True:
            blue = [(self.total(r), -q, c) for q in red for c, r in self.next[q].items() if r not in in_red]
            if not blue:
                break
            n, parent, c = max(blue)
            parent = -parent
            r = self.next[parent][c]
            if n < LEAST:
                after = Counter()
                for q in red:
                    if self.next[q].get(c) in in_red:
                        after[self.next[q][c]] += self.count[q][c]
                to = max(after, key=lambda q: (after[q], -q)) if after else parent
            else:
                to = max((q for q in red if self.compatible(q, r)), key=lambda q: (self.total(q), -q), default=None)
            if to is None:
                red.append(r)
                in_red.add(r)
            else:
                self.next[parent][c] = to
                self.fold(to, r)
        self.states = len(red)
        return self

    def log_likelihood(self, s: str) -> float:
        """Of the string's length and symbols, for each symbol and the end; unseen steps and lengths cost as much as one more of
        a smoothed state."""
        at, n = 0, sum(self.lengths.values())
        near = sum(self.lengths[k] for k in range(len(s) - 2, len(s) + 3)) / 5  # lengths close by count a little
        total = math.log((0.9 * self.lengths[len(s)] + 0.1 * near + 0.02) / (n + 1))
        for c in map(symbol, s):
            n = self.count[at].total()
            total += math.log((self.count[at][c] + 0.02) / (n + 1))
            at = self.next[at].get(c, 0)
        return total / (len(s) + 1)


class Detector:
    """An automaton for each format of each kind, and how often symbols follow each other in plain words (or the words).

    A kind's credentials are told apart by their fixed prefix and, without one, by their classes of characters; formats of
    fewer than LEAST credentials are learnt together, as one more. An automaton is for what follows the prefix, which a
    candidate must have to the letter.
    """

    def __init__(self, credentials: dict[str, list[str]], plain: list[str] | Counter):
        self.formats: dict[tuple[str, str, str], Automaton] = {}
        for kind, strings in sorted(credentials.items()):
            fixed, groups = prefixes(strings), defaultdict(list)
            for s in strings:
                prefix = next((p for p in fixed if s.startswith(p)), "")
                groups[prefix, "" if prefix else shape(s)].append(s[len(prefix) :])
            rest = [s for (p, k), v in groups.items() if not p and len(v) < LEAST for s in v]
            groups = {key: v for key, v in groups.items() if key[0] or len(v) >= LEAST} | ({("", "rest"): rest} if rest else {})
            self.formats |= {(kind, *key): Automaton(v).merge_states() for key, v in sorted(groups.items())}
        pairs = plain if isinstance(plain, Counter) else symbol_pairs(plain)
        total: Counter = Counter()
        for pair, k in pairs.items():
            total[pair[0]] += k
        self.plain = {pair: math.log((k + 0.5) / (total[pair[0]] + 1)) for pair, k in pairs.items()}
        self.unseen = {c: math.log(0.5 / (n + 1)) for c, n in total.items()}
        self.__setstate__(self.__getstate__())

    def __getstate__(self):
        return self.formats, self.plain, self.unseen

    def __setstate__(self, state):
        self.formats, self.plain, self.unseen = state
        self._prefixes = tuple({p for _, p, _ in self.formats if p})
        self._known: dict[str, bool] = {}

    def plain_likelihood(self, s: str) -> float:
        """Of a string as a plain word, for each symbol, the end included. A number is one that plain text has too."""
        w = [EDGE, *map(symbol, s), EDGE]
        return sum(self.plain.get(a + b, self.unseen.get(a, NEVER)) for a, b in zip(w, w[1:])) / (len(s) + 1)

    def gain(self, s: str) -> float:
        """How much better the best format explains a string than plain text does, in nats for each symbol."""
        best = -math.inf
        for (_, prefix, _), automaton in self.formats.items():
            if s.startswith(prefix) and len(s) > len(prefix):
                rest = len(s) - len(prefix) + 1
                best = max(best, automaton.log_likelihood(s[len(prefix) :]) * rest / (len(s) + 1))  # a prefix is certain
        return best - self.plain_likelihood(s)

    def fits(self, s: str) -> bool:
        """Whether a candidate's gain reaches MARGIN; strings of equal symbols and prefix share an answer."""
        key = s.translate(ASCII_SYMBOLS)
        if s.startswith(self._prefixes):
            key = max((p for p in self._prefixes if s.startswith(p)), key=len) + " " + key
        if len(key) > 64:
            return self.gain(s) >= MARGIN
        found = self._known.get(key)
        if found is None:
            if len(self._known) > 50_000:
                self._known = {}
            found = self._known[key] = self.gain(s) >= MARGIN
        return found

    def spans(self, text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, str]]]:
        """The base spans, and the candidates outside of them that fit a format."""
        base, added, at = base_spans(text), [], 0
        taken = sorted((s, e) for _, s, e, _ in base)
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            i = at
            while start < end:
                while i < len(taken) and taken[i][1] <= start:
                    i += 1
                stop = min(end, max(start, taken[i][0])) if i < len(taken) else end
                if stop - start >= SHORTEST and self.fits(text[start:stop]):
                    added.append((ADDED, start, stop, text[start:stop]))
                start = taken[i][1] if stop < end else end
        return base, added


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"
COUNT = pa.struct([("symbol", pa.string()), ("n", pa.int64())])
COUNT_SQL = "array<struct<symbol: string, n: bigint>>"


def _listed(spans: list[tuple[str, int, int, str]]) -> list[dict]:
    return [dict(zip(("kind", "start", "end", "value"), s)) for s in spans]


def _scan(batches):
    for batch in batches:
        spans, words = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            spans.append(_listed(base))
            words += plain_words(text, base)
        plain = [[{"symbol": c, "n": n} for c, n in symbol_pairs(words).items()], *([[]] * (len(spans) - 1))][: len(spans)]  # a batch's pairs stand in its first row
        yield pa.RecordBatch.from_arrays([pa.array(spans, pa.list_(SPAN)), pa.array(plain, pa.list_(COUNT))], ["base", "plain"])


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """base (the patterns' spans of each row) and plain (counts of symbol pairs, to be added up over all rows): one pass over the
    whole texts."""
    small_batches(spark)
    return docs.select(text_or_empty().alias("text")).mapInArrow(_scan, f"base {SPAN_SQL}, plain {COUNT_SQL}")


def _about(df: DataFrame, wanted: int, *key: str) -> DataFrame:
    """Some twice the wanted number of rows, by their hashes, so that no task sends the driver its own whole share."""
    every = max(1, df.count() // (2 * wanted))
    return df.where(F.pmod(F.xxhash64(F.lit(5), *key), F.lit(every)) == 0)


def fit(scanned: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> Detector:
    """Learns the formats from at most ``per_kind`` distinct credentials of each kind, those with the smallest hashes of a
    sample by hash, and plain text from the words of every whole text: one row for each pair of symbols reaches the driver."""
    values = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()
    values = Scratch(scanned.sparkSession, "secrets").put(values, "values")
    few = {k: _about(values.where(F.col("kind") == k), per_kind, "value") for k in KINDS}
    sample = {k: [r["value"] for r in v.orderBy(F.xxhash64("value"), "value").limit(per_kind).collect()] for k, v in few.items()}
    plain = scanned.select(F.explode("plain").alias("p")).groupBy("p.symbol").agg(F.sum("p.n").alias("n"))
    return Detector(sample, Counter({r["symbol"]: r["n"] for r in plain.collect()}))


def _detect(detector):
    def run(batches):
        for batch in batches:
            found = [detector.value.spans(text) for text in batch.column("text").to_pylist()]
            base, added = (pa.array([_listed(f[i]) for f in found], pa.list_(SPAN)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, added], ["doc_id", "base", "added"])

    return run


def find_secrets(spark: SparkSession, docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> DataFrame:
    """One row for each input row: doc_id, base and added, arrays of (kind, start, end, value) in code points.

    A null or empty text has no spans. Repeated rows give repeated results; null ids are scanned like others; other
    columns are ignored; an empty table gives an empty result, and without labelled credentials nothing is added.
    """
    scanned = Scratch(spark, "secrets").put(scan(spark, docs), "scanned")
    detector = spark.sparkContext.broadcast(fit(scanned, per_kind))
    text = docs.select("doc_id", text_or_empty().alias("text"))
    return text.mapInArrow(_detect(detector), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN_SQL}, added {SPAN_SQL}")


MASK = "[secret]"


def _redact(detector):
    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    texts.append(None)
                    continue
                base, added = detector.value.spans(text)
                at, parts = 0, []
                for s, e in sorted((s, e) for _, s, e, _ in base + added):
                    if s >= at:
                        parts += [text[at:s], MASK]
                    at = max(at, e)
                texts.append("".join([*parts, text[at:]]))
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact(spark: SparkSession, docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> DataFrame:
    """The rows of docs with MASK in place of every span, and n_chars, where there is one, as the text now is."""
    scanned = Scratch(spark, "redact").put(scan(spark, docs), "scanned")
    detector = spark.sparkContext.broadcast(fit(scanned, per_kind))
    out = docs.mapInArrow(_redact(detector), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By start, then kind as listed (added ones last)."""
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0))
    key = lambda s: s["start"] * 4 + F.when(rank(s) == 0, 3).otherwise(rank(s) - 1)
    return F.array_sort(spans, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark, documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    all_spans = found.withColumn("all", in_order(F.concat("base", "added")))
    return all_spans.select("doc_id", *map(count, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}
