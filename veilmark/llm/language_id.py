"""Language identification by nearest centroid.

Method.  A text becomes a vector of its n-grams of one to three bytes of letters (lower case; bytes of UTF-8, so one to
three letters of Latin script, and one of others), hashed to ``DIMS`` dimensions, weighted by TF-IDF and normalised.  Each language has several centroids, found by spherical
k-means on labelled documents; a text takes the language of the centroid of greatest cosine.  A text is rejected if
even that centroid is too far away: its cosine is under the language's radius, a share of the median cosine that the
language's documents have with centroids fitted without them.  The rule is the same for few documents and many.

Scale.  Two narrow passes over the texts, in batches of arrays.  The first counts, over all training documents, in how
many each n-gram occurs (a row for each n-gram and task, summed map-side and by key), and draws the bounded sample
(``SAMPLE_PER_LANGUAGE`` by hash of the id) that the centroids are fitted on, in a task for each language; the second
predicts.  The driver holds the centroids, 64 KB a language, and a table of ``DIMS`` counts, whatever the corpus' size.

Defined cases.  Texts that are null or have no letter are ``und`` with score 0 and are rejected.  Without training
documents every text is ``und``, and ``keep`` keeps what has a letter.  Rows of a null language are not learned from;
null ids count as held out.  Of centroids at the same cosine the first wins, languages by name.  Repeated rows each get a
row, and weigh each in what is learned.  An empty table gives an empty result.  Extra columns, whatever their names, do
not matter.  A very long text is counted whole, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm import staging
from veilmark.llm.sequences import handed_back, mixed, runs

DIMS = 1 << 12
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS = 4
FOLDS = 5
#: A text is rejected whose cosine is under this share of the median one.
SLACK = 0.125
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of letters: ASCII letters, and all of multi-byte characters; the rest separates words.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ROWS = 256


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)) == 0


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of n-gram counts for each text: of single bytes of letters, and of what follows them, to three bytes.

    An n-gram begins in a word and may run over its end, which is one value whatever stands there.
    """
    n = len(offsets) - 1
    low = _LOWER[data]
    if len(low) > 1:
        latin = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low[1:][latin] += 0x20
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    value = np.where(letter, low, 0).astype(np.uint64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * DIMS, np.int64)
    gram, whole = value.copy(), letter.copy()
    for size in (1, 2, 3):
        if size > 1:
            if len(data) < size:
                break
            step = value[size - 1 :]
            gram = (gram[: len(step)] << np.uint64(8)) | step
            crossing = edge[size - 1 : size - 1 + len(step)]
            whole = whole[: len(step)] & ~crossing
        at = np.flatnonzero(whole)
        where = (mixed(gram[at] + np.uint64(size << 40)) & np.uint64(DIMS - 1)).astype(np.int64)
        out += np.bincount(text[at] * DIMS + where, minlength=n * DIMS)
    return out.reshape(n, DIMS)


def packed(counts: np.ndarray) -> bytes:
    """The places and values of what isn't zero: a few kilobytes for a document."""
    at = np.flatnonzero(counts)
    return np.stack([at, counts[at]]).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    at, value = np.frombuffer(data, "<u4").reshape(2, -1)
    counts = np.zeros(DIMS, np.int64)
    counts[at] = value
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; rows of nothing stay zero."""
    rows = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=rows, where=norm > 0)


def _profiled(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the first row, counts) of at most ROWS rows and about two megabytes."""
    for at in range(0, len(column), ROWS):
        for low, data, offsets in runs(column.slice(at, ROWS)):
            yield at + low, profiles(data, offsets)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starting points; the same rows give the same centroids."""
    centres = rows[:1]
    near = rows @ rows[0]
    for _ in range(min(k, len(rows)) - 1):
        pick = int(near.argmin())
        centres = np.concatenate([centres, rows[pick : pick + 1]])
        near = np.maximum(near, rows @ rows[pick])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        new = np.stack([rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


class Model:
    """Centroids with their languages and radii, and the inverse document frequencies."""

    def __init__(self, languages: list[str], centroids: np.ndarray, radii: np.ndarray, idf: np.ndarray) -> None:
        self.languages, self.centroids, self.radii, self.idf = languages, centroids, radii, idf

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the centroid, cosine, rejected) of each row of counts."""
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(best)), best]
        return best, np.clip(score.astype(float), 0, 1), score < self.radii[best]


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """Learn from docs; None if there is nothing to learn from.

    The sample is of at most about ``sample_per_language`` documents a language, by hash of the id.
    """
    known = docs.filter(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[id_col].cast("string").alias("id"), docs[lang].alias("lang"), docs[text].alias("text"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for l, n in sorted(sizes.items()) for x in (l, min(1.0, sample_per_language / n))))
    drawn = known.select("lang", "text", (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20)).alias("drawn"))

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("vector", pa.binary())])
        found, seen = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            langs, take = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for at, counts in _profiled(batch.column(1)):
                found += (counts > 0).sum(axis=0)
                seen += len(counts)
                rows = [(langs[at + i], packed(c)) for i, c in enumerate(counts) if take[at + i]]
                if rows:
                    own, vectors = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.int64()), pa.array(vectors, pa.binary())], schema=schema)
        dims = np.r_[np.flatnonzero(found), -1]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(dims), pa.string()), pa.array(dims, pa.int32()), pa.array(np.r_[found[found > 0], seen]), pa.nulls(len(dims), pa.binary())], schema=schema)

    learned = staging.stage(drawn.mapInArrow(run, "lang string, dim int, n long, vector binary"), "learned")
    counts = {r.dim: r.n for r in learned.filter("dim is not null").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(-1)
    often = np.zeros(DIMS)
    often[list(counts)] = list(counts.values())
    idf = (np.log((1 + total) / (1 + often)) + 0.05).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def one(table: pa.Table) -> pa.Table:
        """A language's centroids, and how near they are to documents that they were not fitted on."""
        vectors = sorted(v.as_py() for v in table.column("vector"))
        rows = np.zeros((len(vectors), DIMS), np.float32)
        for i, vector in enumerate(vectors):
            rows[i] = weighted(unpacked(vector)[None], shared.value)
        halves = rows[::2], rows[1::2]
        apart = [(other @ clustered(half, centroids).T).max(axis=1) for half, other in (halves, halves[::-1]) if len(half) and len(other)]
        radius = SLACK * float(np.median(np.concatenate(apart))) if apart else 0.0
        own = clustered(rows, centroids).astype("<f4")
        return pa.table({"lang": [table.column("lang")[0].as_py()], "radius": [radius], "centroids": pa.array([own.tobytes()], pa.binary())})

    drawn_ = learned.filter("vector is not null").select("lang", "vector")
    fitted = sorted(drawn_.groupBy("lang").applyInArrow(one, "lang string, radius double, centroids binary").collect(), key=lambda r: r.lang)
    centres = [np.frombuffer(bytes(r.centroids), "<f4").reshape(-1, DIMS) for r in fitted]
    names = [r.lang for r, own in zip(fitted, centres) for _ in own]
    radii = [r.radius for r, own in zip(fitted, centres) for _ in own]
    return Model(names, np.concatenate(centres).astype(np.float32), np.array(radii), idf) if fitted else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score, rejected."""
    own = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text].alias("text"))
    if model is None:
        return own.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of DIMS numbers

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(2)
            for at, counts in _profiled(column):
                n = len(counts)
                best, score, rejected = own.predict(counts)
                langs = [own.languages[b] for b in best]
                for i in range(n):
                    if not counts[i].any() or not _lettered(column[at + i]):
                        langs[i], score[i], rejected[i] = UNKNOWN, 0.0, True
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(langs), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _lettered(value: pa.Scalar) -> bool:
    text = value.as_py() or ""
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def keep(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """docs without those whose language is rejected; lang becomes the predicted language, other columns stay."""
    model = fit(docs.filter(~held_out(docs[id_col])), text, id_col, lang)
    if model is None:
        return docs.filter(docs[text].rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at_text, at_lang = batch.schema.get_field_index(text), batch.schema.get_field_index(lang)
            column = batch.column(at_text)
            for at, counts in _profiled(column):
                best, _, rejected = own.predict(counts)
                some = [i for i in range(len(counts)) if not rejected[i] and counts[i].any() and _lettered(column[at + i])]
                part = batch.take(pa.array([at + i for i in some], pa.int64()))
                langs = pa.array([own.languages[best[i]] for i in some], pa.string())
                yield pa.RecordBatch.from_arrays([langs if c == at_lang else part.column(c) for c in range(part.num_columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs.filter(~held_out(docs["doc_id"]))))
