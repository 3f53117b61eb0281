"""Subject areas of documents: complement naive Bayes, EM over all documents, calibration.

1. Words are hashed to a fixed number of buckets; each document keeps its bucket counts.
2. Complement naive Bayes is trained on labelled documents: for each subject a word has the
   ratio of its share in the subject's documents to its share in all others, so a subject
   with few labels isn't drowned.
3. Expectation-maximization over all documents refines it: a document may have several
   subjects, so each of its words is shared among them and none by the classifier's
   ratios and the document's own mixture; the shares are the next round's counts.
4. For each subject the evidence of the labelled documents, each classified by a model from
   which what its own labels taught is taken out, is calibrated to a posterior of its own by
   logistic regression; posteriors needn't add up to one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import joined, run_hashes
from tagloom.plans.lineage import cut

BUCKETS = 1 << 17
#: Labelled documents that the classifier is fitted on, at most.
LABELLED = 50_000
_SMOOTH = 0.1
#: Weight of a labelled document among the unlabelled ones in EM.
_LABEL_WEIGHT = 5.0
#: Prior log odds of a word against each subject.
_AGAINST = 0.5
#: Ratio of words that a subject's documents hold less than half a time.
_ABSENT = math.exp(-3.0)
#: Subjects at most: the model has a column for each.
MOST_SUBJECTS = 1000

_DIFF = re.compile(r"^diff --git ", re.M)
_KEPT = re.compile(r"^(?:[+-](?!\+\+ |-- ).*|diff --git .*)$", re.M)
_PATH = re.compile(r"^diff --git \S+ ", re.M)
_PATHS = re.compile(r"^diff --git \S+ (.*)$", re.M)
_HEAD = re.compile(r"^(?:commit [0-9a-f]{7,}|From [0-9a-f]{7,}|From:|Author:|AuthorDate:|Commit:|CommitDate:|Date:|Merge:|Signed-off-by:|Co-authored-by:|Reviewed-by:|Acked-by:|Cc:).*$", re.M)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER_OF = np.arange(256, dtype=np.uint8)
_LOWER_OF[65:91] += 32


def own_text(text: str) -> str:
    """Message, paths and changed lines of a commit; unchanged lines and headers left out."""
    m = _DIFF.search(text)
    message = _HEAD.sub("", text[: m.start()] if m else text)
    if not m:
        return message
    return message + "\n" + _PATH.sub("", "\n".join(_KEPT.findall(text, m.start())))


def head_text(text: str) -> str:
    """Message and paths of a commit: where it names what it is about."""
    m = _DIFF.search(text)
    message = _HEAD.sub("", text[: m.start()] if m else text)
    return message + "\n" + "\n".join(_PATHS.findall(text, m.start())) if m else message


def bucket_counts(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the words of each text, sorted; words split at capitals."""
    buf, starts = joined(texts)
    letter = _LETTER[buf]
    up = _UPPER[buf]
    begins = np.zeros(len(buf), bool)
    begins[1:] = up[1:] & ~up[:-1]
    low = _LOWER_OF[buf]
    c3 = np.zeros(len(buf), bool)
    c3[1:] = buf[:-1] == 0xC3
    low = np.where(c3 & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), low + 32, low).astype(np.uint8)
    h, at, length = run_hashes(low, letter, begins)
    keep = length >= 3  # shorter runs of letters are no words
    h, at = h[keep], at[keep]
    code = (np.searchsorted(starts, at, side="right") - 1) * buckets + (h % np.uint64(buckets)).astype(np.int64)
    code, n = np.unique(code, return_counts=True)
    return code // buckets, code % buckets, n


def features(docs: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, ids, counts, heads`` of each document: words, their counts, and those in message and paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column(1).to_pylist()
                row, ids, n = bucket_counts([own_text(t) if t else "" for t in texts], buckets)
                r1, i1, n1 = bucket_counts([head_text(t) if t else "" for t in texts], buckets)
                heads = np.zeros(len(ids), np.int64)
                heads[np.searchsorted(row * buckets + ids, r1 * buckets + i1)] = n1  # head words are among all words
                off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                n, heads = n.astype(np.int32), heads.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(n)), pa.ListArray.from_arrays(off, pa.array(heads))],
                    ["doc_id", "ids", "counts", "heads"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
    return slim.mapInArrow(run, "doc_id long, ids array<int>, counts array<int>, heads array<int>")


def votes(labels: DataFrame, doc_id: str, subject: str, rater: str | None, names: list[str], most: int = LABELLED) -> DataFrame:
    """``doc_id, y``: share of a document's raters that gave each subject; last, none of them.

    Repeated rows count once; spelling is compared trimmed and in lower case; unknown
    subjects and null ids are left out.  ``most`` documents at most, by hash.
    """
    s = F.lower(F.trim(F.regexp_replace(subject, r"\s+", " ")))
    r = F.coalesce(F.col(rater), F.lit("")) if rater else F.lit("")
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), s.alias("s"), r.alias("r")).where("doc_id is not null and s is not null").distinct()
    low = [n.lower() for n in names]
    rows = rows.where(F.col("s").isin(*low, "none"))
    y = [F.count_distinct(F.when(F.col("s") == n, F.col("r"))) / F.count_distinct("r") for n in (*low, "none")]
    return rows.groupBy("doc_id").agg(F.array(*y).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, damped count) of a batch of features."""
    lists = batch.column("ids")
    off = np.asarray(lists.offsets).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(off))
    ids = np.asarray(lists.flatten())
    n = np.asarray(batch.column("counts").flatten()).astype(np.float64)
    return row, ids, np.log1p(n)


def complement_ratios(counts: np.ndarray, sizes: np.ndarray | None = None, buckets: int | None = None) -> np.ndarray:
    """The classifier: for each word and subject P(word | subject) / P(word | other documents), with the prior odds.

    counts: words by subjects, the documents of no subject last; ``sizes`` and ``buckets``
    those of the whole table where only some of its rows are given.
    """
    sizes = counts.sum(0) if sizes is None else sizes
    buckets = len(counts) if buckets is None else buckets
    total, all_ = counts.sum(1, keepdims=True), sizes.sum()
    inside = (counts + _SMOOTH) / (sizes + _SMOOTH * buckets)
    outside = (total - counts + _SMOOTH) / (all_ - sizes + _SMOOTH * buckets)
    ratio = inside / outside * math.exp(-_AGAINST)
    return np.where(counts < 0.5, _ABSENT, ratio)[:, :-1]


def shares(ratio: np.ndarray, row: np.ndarray, tf: np.ndarray, rows: int, rounds: int = 4, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words' shares, documents' evidence): each word of a document split among the subjects and none, last.

    ratio: for each word of the batch what the classifier says.  ``prior`` holds the
    documents' known mixtures; without it they are estimated by a few rounds of EM within
    each document.
    """
    p = np.concatenate([ratio, np.ones((len(ratio), 1), ratio.dtype)], 1)
    k = p.shape[1]
    theta = np.full((rows, k), 1.0 / k) if prior is None else prior
    share, evidence = np.zeros_like(p), np.zeros((rows, k))
    for _ in range(rounds if prior is None else 1):
        share = p * theta[row]
        share *= (tf / np.maximum(share.sum(1), 1e-300))[:, None]
        evidence = np.stack([np.bincount(row, share[:, c], rows) for c in range(k)], 1)
        theta = (evidence + 0.05) / (evidence.sum(1, keepdims=True) + 0.05 * k)
    return share, evidence


def _mixture_of(y: np.ndarray) -> np.ndarray:
    """Mixtures of labelled documents: what the raters gave, and as much of none."""
    prior = np.concatenate([y[:, :-1] / np.maximum(y.sum(1, keepdims=True), 1e-9), np.ones((len(y), 1))], 1) + 1e-6
    return prior / prior.sum(1, keepdims=True)


def _summed(feats: DataFrame, fold, buckets: int, k: int) -> np.ndarray:
    """Sum over all documents of a (buckets, k) table; each task sends its non-zero rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, k))
        for batch in batches:
            if batch.num_rows:
                fold(batch, total)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, c]) for c in range(k)]], ["b", *[f"c{c}" for c in range(k)]])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((buckets, k), np.float32)
        for batch in batches:
            out[np.asarray(batch.column(0))] = np.stack([np.asarray(batch.column(c + 1)) for c in range(k)], 1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["table"])

    schema = "b int, " + ", ".join(f"c{c} double" for c in range(k))
    rows = feats.mapInArrow(run, schema).groupBy("b").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)])
    # one task, buckets rows at most; what the driver gets is of the same size for any corpus
    table = rows.repartition(1).mapInArrow(dense, "table binary").collect()
    return np.frombuffer(table[0][0], np.float32).reshape(buckets, k).astype(np.float64) if table else np.zeros((buckets, k))


def _add(total: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    for c in range(total.shape[1]):
        total[:, c] += np.bincount(ids, values[:, c], len(total))


def _in_head(batch: pa.RecordBatch, row: np.ndarray, tf: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The part of the evidence that stands in message and paths."""
    head = np.log1p(np.asarray(batch.column("heads").flatten()).astype(np.float64)) / tf
    share = share * head[:, None]
    return np.stack([np.bincount(row, share[:, c], batch.num_rows) for c in range(share.shape[1])], 1)


def evidences(model: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each subject in the documents of a batch, and the part of it in message and paths."""
    row, ids, tf = _flat(batch)
    share, evidence = shares(model[ids], row, tf, batch.num_rows)
    return evidence, _in_head(batch, row, tf, share)


def evidence_features(evidence: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: (documents, subjects, features).

    Amount and share of the evidence, in all and in message and paths, as piecewise linear
    terms: a subject that is only mentioned has little of all, or none in the head.
    """
    e, h = evidence[:, :-1], head[:, :-1]

    def parts(x):
        return x / np.maximum(x.sum(1, keepdims=True), 1e-9), x / np.maximum(x.max(1, keepdims=True), 1e-9)

    def bent(x, *at):
        return [x, *(np.maximum(x - c, 0) for c in at)]

    (se, me), (sh, mh), le, lh = parts(e), parts(h), np.log1p(e), np.log1p(h)
    shares = (0.05, 0.15, 0.25, 0.35)
    return np.stack([
        np.ones_like(e), *bent(le, 0.3, 0.7, 1.1, 1.8), *bent(lh, 0.2, 0.4, 0.7, 1.2), *bent(se, *shares), *bent(sh, *shares),
        me, mh, se * sh, lh * se, le * sh,
    ], 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps, each halved until the loss falls."""
    b = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (b @ b))

    now = loss(b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        for _ in range(30):
            new = loss(b + step)
            if new < now:
                break
            step = step / 2
        else:
            break
        b, gain, now = b + step, now - new, new
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    return b


class SubjectModel:
    """A fitted model: word table, calibration and names; small, of a size that doesn't grow."""

    def __init__(self, names: list[str], model: np.ndarray, weights: np.ndarray):
        self.names, self.model, self.weights = names, model.astype(np.float32), weights

    def posteriors(self, batch: pa.RecordBatch) -> np.ndarray:
        z = np.einsum("dcf,cf->dc", evidence_features(*evidences(self.model, batch)), self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def assign(self, feats: DataFrame, least: float = 0.5, each: int | None = None) -> DataFrame:
        """``doc_id, subject, posterior`` where the subject's own posterior reaches ``least``; the ``each`` best where that is given."""
        table = pa.array(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = self.posteriors(batch)
                    ok = p >= least
                    if each is not None:
                        ok &= np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1) < each
                    d, c = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), table.take(pa.array(c)), pa.array(p[d, c])], ["doc_id", "subject", "posterior"])

        return feats.mapInArrow(run, "doc_id long, subject string, posterior double")


def fit(feats: DataFrame, labelled: DataFrame, names: list[str], rounds: int = 2, buckets: int = BUCKETS) -> SubjectModel:
    """Fit on ``labelled`` (``doc_id, y`` of :func:`votes`) and all of ``feats``."""
    k = len(names) + 1
    known = cut(feats.join(F.broadcast(labelled), "doc_id"))  # LABELLED documents at most

    def y_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("y").flatten()).reshape(-1, k)

    def count(batch, total):
        row, ids, tf = _flat(batch)
        y = y_of(batch)
        _add(total, ids, tf[:, None] * (y / np.maximum(y.sum(1, keepdims=True), 1e-9))[row])

    def supervised(batch, total, model):
        row, ids, tf = _flat(batch)
        share, _ = shares(model[ids], row, tf, batch.num_rows, prior=_mixture_of(y_of(batch)))
        _add(total, ids, share)

    def unsupervised(batch, total, model):
        row, ids, tf = _flat(batch)
        share, _ = shares(model[ids], row, tf, batch.num_rows)
        _add(total, ids, share)

    counts = _summed(known, count, buckets, k)
    model = before = complement_ratios(counts)
    for _ in range(rounds):
        before = model.astype(np.float32)
        taught = _summed(known, lambda b, t, m=before: supervised(b, t, m), buckets, k)
        counts = _summed(feats, lambda b, t, m=before: unsupervised(b, t, m), buckets, k) + (_LABEL_WEIGHT - 1) * taught
        model = complement_ratios(counts)
    sizes, all_counts, last = counts.sum(0), counts.astype(np.float32), before

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of labelled documents from counts without what their labels taught: they then stand as all others do."""
        for batch in batches:
            if not batch.num_rows:
                continue
            row, ids, tf = _flat(batch)
            y = y_of(batch)
            if rounds:
                own = (_LABEL_WEIGHT - 1) * shares(last[ids], row, tf, batch.num_rows, prior=_mixture_of(y))[0]
            else:
                own = tf[:, None] * (y / np.maximum(y.sum(1, keepdims=True), 1e-9))[row]
            ratio = complement_ratios(np.maximum(all_counts[ids] - own, 0), sizes, buckets)
            share, e = shares(ratio, row, tf, batch.num_rows)
            h = _in_head(batch, row, tf, share)
            flat = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), k).cast(pa.list_(pa.float32())) for x in (e, h)]
            yield pa.RecordBatch.from_arrays([*flat, batch.column("y")], ["e", "h", "y"])

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(c).flatten()).astype(np.float64).reshape(-1, k) for c in range(3)] for b in batches if b.num_rows]
        e, h, y = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, k)),) * 3
        w = calibrate(e, h, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["w"])

    # LABELLED documents at most, so the regression is one task's work and only its weights travel
    gathered = known.mapInArrow(evidence, "e array<float>, h array<float>, y array<double>").repartition(1)
    weights = np.array([r[0] for r in gathered.mapInArrow(calibrated, "w array<double>").collect()])
    return SubjectModel(names, model, weights if len(weights) else calibrate(*(np.zeros((0, k)),) * 3))


def calibrate(e: np.ndarray, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights per subject: slopes from all subjects together, the level from each one's own labels.

    Raters err: the share of labels given where the evidence is beyond doubt, and where
    there is none, tells how often.  The targets are corrected for both rates.
    """
    x, k = evidence_features(e, h), e.shape[1] - 1
    if not len(y):
        return np.tile(np.concatenate([[-30.0], np.zeros(x.shape[2] - 1)]), (k, 1))
    own, sum_ = e[:, :k], e[:, :k].sum(1, keepdims=True)
    target = np.minimum(y[:, :k], 1)
    sure, clear = (own > 5) & (own > 0.9 * sum_), own < 0.05
    given = target[sure].mean() if sure.any() else 1.0
    stray = target[clear].mean() if clear.any() else 0.0
    if given - stray > 0.3:
        target = (target - stray) / (given - stray)
    pooled = fit_logistic(x.reshape(-1, x.shape[2]), target.reshape(-1), np.ones(target.size))
    out = np.tile(pooled, (k, 1))
    for c in range(k):
        # one Newton fit of the level alone, held back where labels are few
        z, t, level = x[:, c] @ pooled, target[:, c], 0.0
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(z + level, -30, 30)))
            level += np.clip(((t - p).sum() - 20 * level) / ((p * (1 - p)).sum() + 20), -1, 1)
        out[c, 0] += level
    return out


def assign_subjects(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, rater: str | None, names: list[str], rounds: int = 2, least: float = 0.5, each: int | None = None, most: int = LABELLED) -> DataFrame:
    """``doc_id, subject, posterior`` of each document's subjects, however many; none for those about no subject.

    Null and empty texts have no subject; repeated ids give the rows of each; documents
    needn't be labelled.  Without usable labels no subject is given.
    """
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    if not names:
        return docs.sparkSession.createDataFrame([], "doc_id long, subject string, posterior double")
    feats = cut(features(docs, doc_id, text))
    return fit(feats, votes(labels, label_id, label, rater, names, most), names, rounds).assign(feats, least, each)
