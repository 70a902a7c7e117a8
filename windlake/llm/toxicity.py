"""Toxicity: a counterfactual-regularised linear classifier, learnt from the labelled rows.

Features are words and word beginnings; the most telling ones are kept. Training adds, for each labelled text that names
a group of people, a penalty on the change of its score when the group is swapped for others of the same kind in the same
language, on average, so a neutral mention of a group doesn't move the score. Text is the only input of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, small_batches, text_or_empty

#: At most so many labelled rows are learnt from: those with the smallest hashes of their ids.
MAX_TRAINING_ROWS = 24_000
MAX_FEATURES = 30_000
HASH_BITS = 22
FAIRNESS = 1.0  # weight of the penalty on score changes under swaps
PREFIXES = range(3, 9)
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")

#: Terms for groups of people, a line for each kind and language; a swap stays within its line.
IDENTITY = [
    "women men girls boys",
    "femmes hommes filles garçons",
    "frauen männer mädchen jungen",
    "mujeres hombres niñas niños",
    "muslims christians jews hindus buddhists atheists",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "muslime christen juden hindus buddhisten atheisten",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "gay lesbian bisexual transgender straight homosexual heterosexual",
    "gay lesbienne bisexuel transgenre homosexuel hétérosexuel",
    "schwul lesbisch bisexuell transgender homosexuell heterosexuell",
    "gay lesbiana bisexual transgénero homosexual heterosexual",
    "black white asian latino arab african european",
    "noir blanc asiatique latino arabe africain européen",
    "schwarz weiß asiatisch arabisch afrikanisch europäisch",
    "negro blanco asiático latino árabe africano europeo",
    "immigrants refugees foreigners citizens",
    "immigrés réfugiés étrangers citoyens",
    "einwanderer flüchtlinge ausländer bürger",
    "inmigrantes refugiados extranjeros ciudadanos",
    "disabled blind deaf autistic",
    "handicapé aveugle sourd autiste",
    "behindert blind taub autistisch",
    "discapacitado ciego sordo autista",
    "old young elderly teenage",
    "vieux jeunes âgés adolescents",
    "alte junge ältere jugendliche",
    "viejos jóvenes mayores adolescentes",
]
#: The other terms of a term's lines.
PARTNERS = {w: sorted({x for line in map(str.split, IDENTITY) if w in line for x in line} - {w}) for line in map(str.split, IDENTITY) for w in line}


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << HASH_BITS) - 1
    names = [word + "$", *("^" + word[:k] for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(n.encode()) & mask for n in names]


@dataclass
class Vectoriser:
    """Sparse vectors over the kept features: log counts of words, added up by feature and scaled to length 10."""

    index: dict[int, int]

    def __post_init__(self):
        self._words: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self._words.get(word)
        if found is None:
            if len(self._words) > 100_000:
                self._words = {}
            found = self._words[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return found

    def __call__(self, counts: Counter) -> dict[int, float]:
        x: dict[int, float] = {}
        for word, n in counts.items():
            for f in self._of(word):
                x[f] = x.get(f, 0.0) + math.log1p(n)
        scale = 10 / math.sqrt(sum(v * v for v in x.values())) if x else 1.0
        return {f: v * scale for f, v in x.items()}


def swaps(counts: Counter) -> list[Counter]:
    """The counts after each swap of one of the text's identity terms for one of its partners."""
    out = []
    for word in counts.keys() & PARTNERS.keys():
        for other in PARTNERS[word]:
            changed = counts.copy()
            del changed[word]
            changed[other] += counts[word]
            out.append(changed)
    return out


def score_change(vector: Vectoriser, x: dict[int, float], counts: Counter) -> dict[int, float]:
    """A text's vector less the mean of its swaps' vectors; empty without any: its product with the weights is how far the
    score moves, on average, when only the group that is named changes."""
    others = swaps(counts)
    d = dict(x) if others else {}
    for other in others:
        for f, v in vector(other).items():
            d[f] = d.get(f, 0.0) - v / len(others)
    return d


@dataclass
class Model:
    index: dict[int, int]
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def __post_init__(self):
        self._vector = Vectoriser(self.index)

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] * v for f, v in self._vector(word_counts(text)).items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.scale * z + self.shift))))

    def __getstate__(self):
        return self.index, self.weights, self.bias, self.scale, self.shift

    def __setstate__(self, state):
        self.index, self.weights, self.bias, self.scale, self.shift = state
        self.__post_init__()


class Rows:
    """Sparse rows, one after the other in flat arrays, for products with vectors."""

    def __init__(self, sizes: np.ndarray, col: np.ndarray, val: np.ndarray, width: int):
        self.n, self.width = len(sizes), width
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.col, self.val = col.astype(np.int32), val.astype(np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w.astype(np.float32)[self.col], minlength=self.n)

    def dot_t(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * e.astype(np.float32)[self.row], minlength=self.width)


@dataclass
class Part:
    """A partition's learning rows, their labels, and the score changes of those with swaps; and rows that set the threshold."""

    x: Rows
    y: np.ndarray
    d: Rows
    x_check: Rows
    y_check: np.ndarray


def loss_and_slope(part: Part, theta: np.ndarray, weights: tuple[float, float], swapped: int, fairness: float) -> np.ndarray:
    """A part's share of the loss, followed by its slope: weighted logistic loss, and fairness * mean (w . (x - mean of its
    swaps))^2. Shares add up over the parts; ``weights`` are those of a clean and of a toxic row."""
    w = theta[:-1]
    z = np.clip(part.x.dot(w) + theta[-1], -60, 60)
    weight = np.where(part.y > 0, weights[1], weights[0])
    e = (1 / (1 + np.exp(-z)) - part.y) * weight
    out = np.concatenate([[(weight * (np.logaddexp(0, z) - part.y * z)).sum()], part.x.dot_t(e), [e.sum()]])
    if part.d.n:
        change = part.d.dot(w)
        out[0] += fairness * (change**2).sum() / swapped
        out[1:-1] += part.d.dot_t(2 * fairness * change / swapped)
    return out


def learn(total, width: int, l2: float = 1e-5, steps: int = 30, memory: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias by L-BFGS. ``total`` adds up loss_and_slope over all parts: about one pass over the rows for each step. An
    empty text is to be clean, and l2 |w|^2 keeps weights small."""

    def whole(theta: np.ndarray) -> tuple[float, np.ndarray]:
        got = total(theta)
        g = got[1:].copy()
        g[:-1] += 2 * l2 * theta[:-1]
        g[-1] += 0.1 / (1 + math.exp(-theta[-1]))
        return got[0] + l2 * float(theta[:-1] @ theta[:-1]) + 0.1 * float(np.logaddexp(0, theta[-1])), g

    theta = np.zeros(width + 1)
    loss, g = whole(theta)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, shares = g.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ q / (y @ s))
            q -= shares[-1] * y
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-12, float(np.linalg.norm(g)))
        for (s, y), share in zip(moves, reversed(shares)):
            q += s * (share - y @ q / (y @ s))
        step, downhill = 1.0, float(g @ q)
        while True:
            to = theta - step * q
            new_loss, new_g = whole(to)
            if new_loss <= loss - 1e-4 * step * downhill or step < 1e-6:
                break
            step /= 2
        if (to - theta) @ (new_g - g) > 1e-12:
            moves = [*moves, (to - theta, new_g - g)][-memory:]
        theta, loss, g = to, new_loss, new_g
    return theta[:-1], float(theta[-1])


def calibrate(z: np.ndarray, labels: np.ndarray, bias: float) -> tuple[float, float]:
    """Scale and shift so that a score of THRESHOLD stands where F1 is best on the rows kept for this, above an empty text."""
    order = np.argsort(-z)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(1, labels.sum()))
    best = int(np.argmax(f1))
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    cut = max(0.7 * below + 0.3 * z[order[best]], bias + 0.5)
    return 1.0, math.log(THRESHOLD / (1 - THRESHOLD)) - cut


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _count_features(batches):
    for batch in batches:
        pos: Counter = Counter()
        neg: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (pos if toxic else neg).update({f for w in word_counts(text) for f in features_of(w)})
        seen = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array([pos[f] for f in seen], pa.int64()), pa.array([neg[f] for f in seen], pa.int64())], ["feature", "pos", "neg"])


def _vectors(index: dict[int, int]):
    """Sparse vectors as packed arrays: of each row (x) and of how its swaps change it (d)."""

    def run(batches):
        vector = Vectoriser(index)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in VECTORS.names}
            for text, toxic, check in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "check"))):
                counts = word_counts(text)
                x = vector(counts)
                d = score_change(vector, x, counts) if not check else {}
                packed = (np.fromiter(v, kind).tobytes() for m in (x, d) for v, kind in ((m.keys(), np.int32), (m.values(), np.float32)))
                for name, value in zip(VECTORS.names, (toxic, check, *packed)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, VECTORS)

    return run


VECTORS = pa.schema([("toxic", pa.int32()), ("check", pa.bool_()), *((n, pa.binary()) for n in ("xf", "xv", "df", "dv"))])


def _part(width: int):
    def run(rows):
        kept: dict[str, list] = {n: [] for n in ("x", "d", "c", "y", "yc")}
        for r in rows:
            x = np.frombuffer(r["xf"], np.int32), np.frombuffer(r["xv"], np.float32)
            kept["c" if r["check"] else "x"].append(x)
            kept["yc" if r["check"] else "y"].append(r["toxic"])
            if r["df"]:
                kept["d"].append((np.frombuffer(r["df"], np.int32), np.frombuffer(r["dv"], np.float32)))
        flat = lambda v: Rows(np.array([len(f) for f, _ in v], int), np.concatenate([f for f, _ in v] or [np.zeros(0, np.int32)]), np.concatenate([x for _, x in v] or [np.zeros(0, np.float32)]), width)
        yield Part(flat(kept["x"]), np.array(kept["y"], float), flat(kept["d"]), flat(kept["c"]), np.array(kept["yc"], float))

    return run


PARTS = 12  # in which the learning rows are kept while their losses are added up


def _labelled(scratch: Scratch, docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, toxic, check of at most ``max_rows`` different labelled documents: one row for each id and text, however often
    they repeat; those with the smallest hashes of ids, and then of ids and texts where an id has several."""
    chosen = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    check = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(5)) == 0
    chosen = scratch.put(chosen.select("doc_id", "toxic", check.alias("check")), "chosen")
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = found.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("again"))
    keys = keys.orderBy(F.xxhash64("doc_id"), F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(max_rows).select("doc_id", "digest")
    keys = scratch.put(keys, "keys")
    rows = found.join(F.broadcast(keys), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(*(F.first(c).alias(c) for c in ("text", "toxic", "check")))
    return scratch.put(rows.select("text", "toxic", "check"), "rows")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_FEATURES, fairness: float = FAIRNESS) -> Model:
    """Learns from at most ``max_rows`` labelled documents that aren't held out; a fifth of them sets the threshold.

    Their vectors stay in the executors: a step of the optimiser is a pass over them, of which the driver gets one sum for
    each feature. An id that repeats counts once for each of its texts. Without toxic rows nothing is toxic.
    """
    scratch = Scratch(spark, "toxicity")
    rows = _labelled(scratch, docs, labels, max_rows)
    total = rows.where("not check").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    if not total["pos"]:
        return Model({}, np.zeros(0), -3.0, 1.0, 0.0)
    counts = rows.where("not check").mapInArrow(_count_features, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n, p = float(total["pos"] + total["neg"]), float(total["pos"])
    df = F.col("pos") + F.col("neg")
    # the usual chi-square of a feature's presence against the label
    lift = F.pow(F.col("pos") * F.lit(n) - df * F.lit(p), 2) / (df * (F.lit(n + 1) - df))
    kept = counts.where(df >= 3).orderBy(lift.desc(), "feature").limit(max_features).select("feature").collect()
    index = {r["feature"]: i for i, r in enumerate(kept)}
    kinds = "toxic int, check boolean, xf binary, xv binary, df binary, dv binary"
    vectors = scratch.put(rows.repartition(PARTS).mapInArrow(_vectors(index), kinds), "vectors")
    parts = vectors.rdd.mapPartitions(_part(len(index))).persist(StorageLevel.MEMORY_AND_DISK)
    swapped = parts.map(lambda part: part.d.n).sum()
    share = max(1e-3, p / n)
    weights = tuple(v / (p * 0.3 / share + (n - p)) for v in (1.0, 0.3 / share))

    def add(theta: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(theta)
        got = parts.map(lambda part: loss_and_slope(part, sent.value, weights, swapped, fairness)).reduce(lambda x, y: x + y)
        sent.destroy()
        return got

    w, b = learn(add, len(index))

    def scores(part: Part) -> list[np.ndarray]:
        return [np.stack([r.dot(w) + b, y]) for r, y in ((part.x, part.y), (part.x_check, part.y_check))]

    # two numbers for each labelled row, of which there are at most max_rows
    seen, checked = (np.concatenate(v, axis=1) for v in zip(*parts.map(scores).collect()))
    parts.unpersist()
    z, y = checked if checked[1].sum() >= 5 else seen
    scale, shift = calibrate(z, y, b)
    return Model(index, w, b, scale, shift)


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([m.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. A null text is scored as an empty one; a null id isn't held out;
    repeated rows get equal scores; other columns are ignored; an empty table gives an empty result."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    scored = rows.mapInArrow(_score(sent), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small_batches(spark)
    return score(spark, docs, fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}


def _clean(model):
    def run(batches):
        for batch in batches:
            m = model.value
            yield batch.filter(pa.array([m.score(t or "") < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def without_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below THRESHOLD."""
    small_batches(spark)
    return docs.mapInArrow(_clean(spark.sparkContext.broadcast(model)), docs.schema)
