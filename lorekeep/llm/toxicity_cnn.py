"""Toxicity by a convolutional text classifier, trained and run in numpy.

Words (lower-cased, without punctuation) are hashed to rows of an embedding table, together with their beginnings of
three to seven characters, and the rows are added up, so that forms of one stem are near; filters of several widths slide over
the text, each keeps its largest response over the whole text (max pooling), and a logistic layer adds them up. The
scores are shifted, language by language, so that the threshold that was best on held-back training rows comes to lie
at ``THRESHOLD``; the language is read off the text's own function words, never from a column.

Training reads every labelled row whose ``crc32(doc_id) mod 4`` is not 2; a fifth of them, by a hash of the id, is held
back for the thresholds. A first model is trained on the driver, on ``MOST_EACH`` rows of each class at most (of those
with texts of ``LONGEST`` bytes at most; the least by a hash of the id, of several texts of one id the least). It is only
where the rest starts: if those are not all rows, every row, short or long, goes through the network once more, in
shards that each go on from that model, and what the shards moved is averaged over them by the number of times that
they moved it. The thresholds come from counts of all rows held back. The driver holds the first rows, the model, sums
by parameter and the counts by language, a few megabytes whatever the corpus. Scoring reads every whole text, in chunks
of bounded size.

Null and empty texts pool to zero and have the model's base score. Repeated rows score alike; without labelled rows of
both classes every score is 0. An empty table gives no rows; extra columns pass through ``with_scores``, but for one
named ``score``, which is replaced. Null ids are scored and never trained on.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

BUCKETS, WIDTH, FILTERS, SIZES = 1 << 16, 16, 12, (1, 2, 3)
STEMS = range(3, 8)
#: Scale of the first embeddings: small, as the largest response over a long text would else be that of words and
#: beginnings that training never met.
START = 0.01
#: Rows of each class, and bytes of a text, that the first model takes at most.
MOST_EACH = 2500
LONGEST = 1 << 16
STEPS, BATCH, RATE = 1600, 32, 0.1
#: Rows of a shard, about; texts and bytes that it reads at once; the unit of its moves, summed as whole numbers so that
#: the order of the sum decides nothing.
SHARD, READ, READ_BYTES, UNIT = 2048, 256, 1 << 22, 1 << 28
GRID = np.linspace(0.02, 0.98, 97)
THRESHOLD = 0.3
CHUNK = 100_000  # words at once
PAD = max(SIZES) - 1
CLEAN = bytes.maketrans(b".,;:!?\"'()[]{}<>|*$%&#/\\", b" " * 24)
#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is that it was for on with as are this be at by",
    "de": "der die und das ist den von zu mit sich des auf nicht ein eine auch",
    "fr": "le les et des un une du que est pour dans qui sur pas au avec",
    "es": "el los las y una por con para del se lo como su al que es",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def bucket(part: bytes) -> int:
    return 1 + xxhash.xxh32_intdigest(part) % (BUCKETS - 1)  # 0 is the padding


def parts_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    s = word.decode("utf-8", "replace")
    return bucket(word), *(bucket(b"<" + s[:n].encode()) for n in STEMS)


LANGUAGE_OF = {w.encode(): k for k, words in reversed(list(enumerate(FUNCTION_WORDS.values()))) for w in words.split()}


class Words:
    """Numbers of the different words of some texts, with their buckets and languages; number 0 is the padding."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}

    def read(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().translate(CLEAN).split()
        number = self.number
        return np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64)

    def parts(self) -> np.ndarray:
        return np.array([(0,) * (1 + len(STEMS)), *map(parts_of, self.number)], dtype=np.int64)

    def languages(self) -> np.ndarray:
        return np.array([len(LANGUAGES) - 1, *(LANGUAGE_OF.get(w, len(LANGUAGES) - 1) for w in self.number)])


def language(ids: np.ndarray, languages: np.ndarray) -> int:
    counts = np.bincount(languages[ids], minlength=len(LANGUAGES))[:-1]
    return int(counts.argmax()) if counts.any() else len(LANGUAGES) - 1


class Model:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.embedding = (r.standard_normal((BUCKETS, WIDTH)) * START).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [(r.standard_normal((w * WIDTH, FILTERS)) / np.sqrt(w * WIDTH)).astype(np.float32) for w in SIZES]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in SIZES]
        self.out = (r.standard_normal(FILTERS * len(SIZES)) * 0.1).astype(np.float32)
        self.base = np.float32(-2.0)
        self.thresholds = np.full(len(LANGUAGES), THRESHOLD)

    def pooled(self, texts: list[np.ndarray], parts: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Largest response of each filter in each text (at least 0), and where, in the padded row of all words."""
        pieces, starts, at = [], [], 0
        vectors = self.embedding[parts].sum(axis=1) if not places else None
        for ids in texts:
            starts.append(at)
            pieces += [ids, np.zeros(PAD, np.int64)]
            at += len(ids) + PAD
        row = np.concatenate([*pieces, np.zeros(PAD, np.int64)]) if pieces else np.zeros(PAD, np.int64)
        begin = np.array([*starts, at])
        best = np.zeros((len(texts), FILTERS * len(SIZES)), np.float32)
        where = np.zeros(best.shape, np.int64) if places else None
        for lo in range(0, at, CHUNK):
            hi = min(at, lo + CHUNK)
            own = row[lo : hi + PAD]
            x = vectors[own] if vectors is not None else self.embedding[parts[own]].sum(axis=1)
            first, last = np.searchsorted(begin, lo, "right") - 1, np.searchsorted(begin, hi, "left")
            edges = np.maximum(begin[first:last], lo) - lo
            for k, (w, f, b) in enumerate(zip(SIZES, self.filters, self.shift, strict=True)):
                n = hi - lo
                z = np.repeat(b[None], n, 0)
                for j in range(w):
                    z += x[j : n + j] @ f[j * WIDTH : (j + 1) * WIDTH]
                top = np.maximum.reduceat(z, edges, axis=0)
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > best[first:last, columns]
                if places:
                    ends = np.append(edges[1:], n)
                    for d, (s, e) in enumerate(zip(edges, ends, strict=True)):
                        arg = z[s:e].argmax(axis=0) + s + lo
                        where[first + d, columns] = np.where(better[d], arg, where[first + d, columns])
                best[first:last, columns] = np.where(better, top, best[first:last, columns])
        return best, where, row

    def logits(self, texts: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
        return self.pooled(texts, parts)[0] @ self.out + self.base

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        """Probabilities, shifted so that the threshold of the text's language lies at THRESHOLD."""
        words = Words()
        texts = [words.read(raw) for raw in raws]
        spoken = words.languages()
        t = self.thresholds[[language(x, spoken) for x in texts]] if texts else np.empty(0)
        odds = self.logits(texts, words.parts()) - np.log(t / (1 - t)) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Trainer:
    """AdaGrad on the logistic loss; gradients flow to the winning windows only."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memory = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("e", model.embedding), *((f"f{i}", f) for i, f in enumerate(model.filters)), ("o", model.out))}
        self.memory_base, self.memory_shift = 1e-3, [np.full(FILTERS, 1e-3, np.float32) for _ in SIZES]
        self.hits = np.zeros(BUCKETS, np.int64)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, parts: np.ndarray) -> None:
        def move(value: np.ndarray, gradient: np.ndarray, held: np.ndarray) -> None:
            held += gradient**2
            value -= RATE * gradient / np.sqrt(held)

        model, memory = self.model, self.memory
        h, where, row = model.pooled(texts, parts, places=True)
        p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.base, -30, 30)))
        error = ((p - labels) / len(texts)).astype(np.float32)
        hidden = error[:, None] * model.out[None] * (h > 0)
        row = np.append(row, np.zeros(PAD, np.int64))
        gradient_e: list[tuple[np.ndarray, np.ndarray]] = []
        for k, w in enumerate(SIZES):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            g, at = hidden[:, columns], where[:, columns]
            f, total = model.filters[k], np.zeros_like(model.filters[k])
            for j in range(w):
                ids = parts[row[at + j]]
                total[j * WIDTH : (j + 1) * WIDTH] = np.einsum("bf,bfd->df", g, model.embedding[ids].sum(axis=2))
                each = np.repeat((g[:, :, None] * f[j * WIDTH : (j + 1) * WIDTH].T[None]).reshape(-1, 1, WIDTH), ids.shape[-1], 1)
                gradient_e.append((ids.ravel(), each.reshape(-1, WIDTH)))
            move(f, total + 1e-5 * f, memory[f"f{k}"])
            move(model.shift[k], g.sum(0), self.memory_shift[k])
        move(model.out, h.T @ error + 1e-5 * model.out, memory["o"])
        self.memory_base += float(error.sum()) ** 2
        model.base -= np.float32(RATE * float(error.sum()) / np.sqrt(self.memory_base))
        ids, inverse = np.unique(np.concatenate([i for i, _ in gradient_e]), return_inverse=True)
        total = np.zeros((len(ids), WIDTH), np.float32)
        np.add.at(total, inverse, np.concatenate([g for _, g in gradient_e]))
        total[ids == 0] = 0
        memory["e"][ids] += total**2
        model.embedding[ids] -= RATE * total / np.sqrt(memory["e"][ids])
        self.hits[ids] += total.any(axis=1)


def train(texts: list[np.ndarray], labels: np.ndarray, parts: np.ndarray, seed: int = 3) -> Trainer:
    trainer, r = Trainer(Model(seed)), np.random.default_rng(seed)
    for _ in range(max(4, STEPS * BATCH // len(texts))):
        order = r.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            trainer.step([texts[i] for i in some], labels[some], parts)
    return trainer


def flat(model: Model) -> np.ndarray:
    """All parameters but the thresholds, in rows of WIDTH: the embeddings, then the others."""
    rest = np.concatenate([*(f.ravel() for f in model.filters), *model.shift, model.out, [model.base]])
    rest = np.append(rest, np.zeros(-len(rest) % WIDTH))
    return np.concatenate([model.embedding, rest.reshape(-1, WIDTH)]).astype(np.float64)


def unflat(model: Model, values: np.ndarray) -> None:
    model.embedding = values[:BUCKETS].astype(np.float32)
    rest, at = values[BUCKETS:].ravel().astype(np.float32), 0
    for own in [*model.filters, *model.shift, model.out]:
        own[...] = rest[at : at + own.size].reshape(own.shape)
        at += own.size
    model.base = rest[at]


def whole_pass(start: Trainer, rows: DataFrame, n: int) -> Model:
    """The model after every row (doc_id, toxic, text; n of them) was trained on once more, in shards."""
    spark = rows.sparkSession
    shards = max(1, n // SHARD)
    start.hits[:] = 0
    shared = spark.sparkContext.broadcast(start)
    sums = [f"v{i}" for i in range(WIDTH)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now, own, read, raws, labels = flat(shared.value.model), None, None, 0, [], []

        def learn() -> None:
            words = Words()
            texts = [words.read(raw) for raw in raws]
            y, parts = np.array(labels, dtype=np.float32), words.parts()
            for s in range(0, len(texts), BATCH):
                own.step(texts[s : s + BATCH], y[s : s + BATCH], parts)
            raws.clear()
            labels.clear()

        def moved() -> pa.RecordBatch:
            values = flat(own.model) - before
            hits = np.append(own.hits, np.full(len(values) - BUCKETS, read))
            slot = np.flatnonzero(hits)
            values = np.rint(values[slot] * hits[slot, None] * UNIT).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(hits[slot]), *(pa.array(c.copy()) for c in values.T)], ["slot", "hits", *sums])

        size = 0
        for batch in batches:
            for shard, toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                if shard != now:
                    if own:
                        learn()
                        yield moved()
                    now, own, read, size = shard, copy.deepcopy(shared.value), 0, 0
                raws.append(raw)
                labels.append(toxic)
                read, size = read + 1, size + len(raw)
                if len(raws) == READ or size > READ_BYTES:
                    learn()
                    size = 0
        if own:
            learn()
            yield moved()

    order = F.xxhash64("doc_id")
    dealt = rows.withColumn("shard", F.pmod(order, F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", order, "doc_id", F.xxhash64("text"), "toxic")
    moves = in_arrow(dealt.select("shard", "toxic", "text"), step, "slot int, hits long, " + ", ".join(f"{c} long" for c in sums))
    found = moves.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("hits", *sums))).toArrow()  # a row a slot at most
    values, slot = flat(start.model), found["slot"].to_numpy()
    values[slot] += np.stack([found[c].to_numpy() for c in sums], axis=1) / UNIT / found["hits"].to_numpy()[:, None]
    unflat(start.model, values)
    return start.model


def calibrate(model: Model, rows: DataFrame, least: int = 20) -> None:
    """For each language with enough toxic rows, the threshold of best F1 on these rows (toxic, text); else that of all."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LANGUAGES), 2, len(GRID) + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, words = batch.slice(at, 500), Words()
                texts = [words.read(raw) for raw in some.column(1).cast(pa.large_binary()).to_pylist()]
                p = 1 / (1 + np.exp(-np.clip(shared.value.logits(texts, words.parts()), -30, 30)))
                spoken = words.languages()
                np.add.at(counts, ([language(x, spoken) for x in texts], some.column(0).to_pylist(), np.searchsorted(GRID, p, "right")), 1)
        k, label, reached = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, label, reached)] + [pa.array(counts[k, label, reached])], ["k", "label", "reached", "n"])

    counts = np.zeros((len(LANGUAGES), 2, len(GRID) + 1), np.int64)
    told = in_arrow(rows.select("toxic", "text"), step, "k int, label int, reached int, n long")
    for r in told.groupBy("k", "label", "reached").agg(F.sum("n").alias("n")).collect():
        counts[r["k"], r["label"], r["reached"]] = r["n"]

    def best(own: np.ndarray) -> float:
        wrong, caught = own.sum(axis=1, keepdims=True) - own.cumsum(axis=1)[:, :-1]
        f1 = 2 * caught / np.maximum(1, caught + wrong + own[1].sum())
        good = GRID[f1 >= f1.max() - 1e-9]
        return float(good[len(good) // 2])

    model.thresholds[:] = best(counts.sum(axis=0))
    for k, own in enumerate(counts):
        if own.sum(axis=1).min() >= least:
            model.thresholds[k] = best(own)


def held_back(known: DataFrame) -> DataFrame:
    """doc_id, toxic and ``back``: the row is for the thresholds."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [xxhash.xxh32_intdigest(str(k)) % 5 == 0 for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.bool_())], ["doc_id", "toxic", "back"])

    return in_arrow(known, step, "doc_id long, toxic int, back boolean")


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    taught = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    known = known.where(taught).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(taught)
    rows = cut(texts.hint("merge").join(held_back(known), "doc_id"), "labelled")  # labels grow with the corpus: no broadcast
    counts = {(r["toxic"], r["back"]): r["count"] for r in rows.groupBy("toxic", "back").count().collect()}
    n = counts.get((0, False), 0) + counts.get((1, False), 0)
    if not (counts.get((0, False)) and counts.get((1, False))):
        return None
    fit = rows.where("NOT back").drop("back")
    short = fit.where(F.octet_length("text") <= LONGEST)
    order = (F.xxhash64("doc_id"), "doc_id")
    some = short.select("doc_id", "toxic").distinct()
    some = some.where("toxic = 1").orderBy(*order).limit(MOST_EACH).union(some.where("toxic = 0").orderBy(*order).limit(MOST_EACH))
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in some.collect()], "doc_id long, toxic int")  # at most 2 * MOST_EACH pairs of numbers
    first = sorted(tuple(r) for r in short.join(F.broadcast(chosen), ["doc_id", "toxic"]).groupBy("doc_id", "toxic").agg(F.min("text")).collect())
    y = np.array([r[1] for r in first], dtype=np.float32)
    if len(set(y)) == 2:
        words = Words()
        start = train([words.read(r[2].encode()) for r in first], y, words.parts())
    else:
        start = Trainer(Model())
    model = start.model if len(first) == n else whole_pass(start, fit, n)
    enough = min(counts.get((0, True), 0), counts.get((1, True), 0)) >= 20
    calibrate(model, rows.where("back") if enough else rows)
    return model


def with_scores(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``score``; ``training``: the texts of the labelled rows, by default ``docs``."""
    model = fitted(docs if training is None else training, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * WIDTH floats and a little more
    names = [c for c in docs.columns if c != "score"]
    rest = docs.select(*names)
    place = names.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                raws = some.column(place).cast(pa.large_binary()).to_pylist()
                score = own.scores(raws) if own else np.zeros(len(raws))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return in_arrow(rest, step, f"{schema}, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", "text"), labels)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
