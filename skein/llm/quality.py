"""Quality and toxicity of documents by hierarchical empirical Bayes over sites."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import host as host_of
from .store import named, settle, small
from .text import Words, _classify, buffer, mix, slices, words

HEADS = ("poor", "toxic")
BUCKETS = 1 << 18
PREFIXES = (5, 7)
SIGNS = ("!", "|", "#$%&*+<=>@\\^_`{}~", "0123456789")


def style(texts: pa.Array, w: Words) -> np.ndarray:
    """Surface features by document: letter case, signs, lengths, repetition."""
    raw, off = buffer(texts)
    n_bytes = np.maximum(np.diff(off), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[off[1:]] - sums[off[:-1]]) / n_bytes

    upper = share((raw >= 65) & (raw <= 90))
    lower = share((raw >= 97) & (raw <= 122))
    kinds = np.zeros(256, np.uint8)
    for i, chars in enumerate(SIGNS):
        kinds[[ord(c) for c in chars]] = i + 1
    kind = kinds[raw]
    count = w.counts()
    n = len(count)
    key = np.unique((w.doc().astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    lengths = np.zeros(len(w) + 1, np.int64)
    np.cumsum(w.end - w.start, out=lengths[1:])
    some = np.maximum(count, 1)
    return np.stack(
        [
            upper / np.maximum(upper + lower, 1e-9), *(np.log1p(1000 * share(kind == i + 1)) for i in range(len(SIGNS))),
            np.log1p(count), (lengths[w.first[1:]] - lengths[w.first[:-1]]) / some, np.log(np.maximum(distinct, 1) / some),
        ],
        axis=1,
    )


def word_buckets(texts: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word, and of the first PREFIXES bytes of each longer one."""
    raw, _ = buffer(texts)
    _, folded = _classify(raw)
    docs, found = [w.doc()], [w.hash & np.uint64(BUCKETS - 1)]
    size = w.end - w.start
    value = np.zeros(len(w), np.uint64)
    for i in range(max(PREFIXES)):
        at = np.minimum(w.start + i, len(folded) - 1)
        value |= np.where(i < size, folded[at] if len(folded) else np.uint8(0), 0).astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in PREFIXES:
            longer = np.flatnonzero(size > i + 1)
            docs.append(docs[0][longer])
            found.append(mix(value[longer], i + 1) & np.uint64(BUCKETS - 1))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30, piece: int = 1000) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of x is the intercept. Rows are widened by pieces."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        slope, bend = -penalty * w, np.diag(penalty)
        for at in range(0, len(x), piece):
            part = x[at : at + piece].astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (y[at : at + piece] - p)
            bend += (part.T * (p * (1 - p))) @ part
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


class Model:
    """Two logistic regressions over style features and the presence of selected words and beginnings of words."""

    def __init__(self, select: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray], base: dict[str, float]):
        self.select, self.mean, self.scale, self.weights, self.base = select, mean, scale, weights, base

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood ratios (n, heads): the regression's log odds less those of its training rows; 0 without a word."""
        w = words(texts)
        n, k = len(w.first) - 1, int(self.select.max()) + 1
        x = (style(texts, w) - self.mean) / self.scale
        doc, bucket = word_buckets(texts, w)
        feature = self.select[bucket]
        at = np.flatnonzero(feature >= 0)
        pair = np.unique(doc[at].astype(np.int64) * k + feature[at]) if k else np.zeros(0, np.int64)
        out = np.zeros((n, len(HEADS)))
        for i, head in enumerate(HEADS):
            if (b := self.weights.get(head)) is not None:
                s = x.shape[1]
                out[:, i] = x @ b[:s] + b[-1] - self.base[head]
                if k:
                    out[:, i] += np.bincount(pair // k, weights=b[s:-1][pair % k], minlength=n)
        out[w.counts() == 0] = 0
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, features: int = 400, least: int = 3) -> Model:
    """Fit the classifier on a sample of at most `rows` labelled documents, the ones whose ids hash lowest.

    The bound makes what reaches the driver a fixed size: only labels of documents that docs holds count, and of several texts of a labelled doc_id the one
    of least hash is read. A head is fitted on the rows that have its label. Words and their first 5 and 7 bytes enter by the z-score of their document frequency between
    the classes, at least `least` documents and a z of 5, at most `features` a head. A head of which the sample has fewer than
    5 documents of either class gives no evidence.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("poor"), (F.col("toxic") == 1).cast("int").alias("toxic"))
        .groupBy("doc_id").agg(F.max("poor").alias("poor"), F.max("toxic").alias("toxic"))
        .where("doc_id is not null and coalesce(poor, toxic) is not null")
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    sample = sample.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"))
                n = part.num_rows
                doc, bucket = word_buckets(part.column("text"), w)
                key = np.unique((doc.astype(np.int64) << 18) | bucket)
                first = np.searchsorted(key >> 18, np.arange(n + 1)).astype(np.int32)
                s = style(part.column("text"), w)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("poor"), part.column("toxic"),
                        pa.ListArray.from_arrays(pa.array(first), pa.array((key & (BUCKETS - 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel())),
                    ],
                    ["doc_id", "poor", "toxic", "buckets", "style"],
                )

    got = sample.mapInArrow(run, "doc_id bigint, poor int, toxic int, buckets array<int>, style array<double>").toArrow().sort_by("doc_id")
    n = got.num_rows
    if not n:
        return Model(np.full(BUCKETS, -1, np.int16), np.zeros(4 + len(SIGNS)), np.ones(4 + len(SIGNS)), {}, {})
    buckets = got.column("buckets").combine_chunks()
    flat, doc = buckets.flatten().to_numpy(), np.repeat(np.arange(n, dtype=np.int32), np.diff(buckets.offsets.to_numpy()))
    s = got.column("style").combine_chunks().flatten().to_numpy().reshape(n, -1)
    mean, scale = s.mean(0), np.maximum(s.std(0), 1e-6)
    kept: set[int] = set()
    ys = {h: got.column(h).to_numpy(zero_copy_only=False).astype(float) for h in HEADS}  # NaN: no label
    ys = {h: y for h, y in ys.items() if min(np.nansum(y), np.nansum(1 - y)) >= 5}
    for y in ys.values():
        known = ~np.isnan(y)
        p = np.bincount(flat[y[doc] > 0], minlength=BUCKETS)
        df = np.bincount(flat[known[doc]], minlength=BUCKETS)
        rate = y[known].mean()
        z = np.where(df >= least, np.abs(p - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9)), 0)
        kept |= set(np.flatnonzero(z >= 5)[np.argsort(-z[z >= 5], kind="stable")][:features].tolist())
    select = np.full(BUCKETS, -1, np.int16)
    select[sorted(kept)] = np.arange(len(kept))
    x = np.zeros((n, s.shape[1] + len(kept) + 1), np.float32)
    x[:, : s.shape[1]], x[:, -1] = (s - mean) / scale, 1
    f = select[flat]
    x[doc[f >= 0], s.shape[1] + f[f >= 0]] = 1
    del flat, doc, f, got
    weights, base = {}, {}
    for h, y in ys.items():
        known = ~np.isnan(y)
        weights[h] = _logistic(x if known.all() else x[known], y[known])
        base[h] = float(np.log(y[known].mean() / (1 - y[known].mean())))
    return Model(select, mean, scale, weights, base)


def _evidence(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """The columns keep of docs with host, path and the evidence of each head."""
    names = [f"__{h}" for h in HEADS]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                e = model.evidence(part.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "__text"), *(pa.array(e[:, i].copy()) for i in range(len(HEADS)))],
                    [*(c for c in part.schema.names if c != "__text"), *names],
                )

    read = docs.select(*keep, *site(docs), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "__text")
    return read.mapInArrow(run, kinds + "".join(f", `{n}` double" for n in names))


def site(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document; a null is a site of its own name ''.

    Where docs has a string column url and it names a host: that, and the first step of its path. Else its source, and
    the language section within it.
    """
    host, path = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    if dict(docs.dtypes).get("url") == "string":
        own = host_of(F.col("url"))
        step = F.regexp_extract("url", r"^(?:[^:/?#]*:)?//[^/?#]*/([^/?#]*)", 1)
        host, path = F.when(own != "", own).otherwise(host), F.when(own != "", step).otherwise(path)
    return host.alias("__host"), path.alias("__path")


def posteriors(scored: DataFrame, model: Model) -> DataFrame:
    """(host, path, n, and by head the path's sum of probabilities, the host's rate and the strength with which it counts for the path).

    A host's mean probability is shrunk to the mean of all documents, a path's to its host's rate. The pseudo-counts come
    from the data (moments of a beta-binomial): mean(1 - mean) / between-group variance - 1, the
    variance within groups taken off, between 1 and 1e6. The sums run over all documents, once: what follows reads a
    settled table of one row a path.
    """
    p = {h: _sigmoid(F.col(f"__{h}") + F.lit(model.base.get(h, -30.0))) for h in HEADS}
    paths = settle(scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), *(F.sum(p[h]).alias(f"s_{h}") for h in HEADS)))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{h}").alias(f"hs_{h}") for h in HEADS))
    root = hosts.agg(F.sum("hn").alias("gn"), *(F.sum(f"hs_{h}").alias(f"gs_{h}") for h in HEADS)).select(*((F.col(f"gs_{h}") / F.col("gn")).alias(f"g_{h}") for h in HEADS))

    def strength(groups: DataFrame, n: str, s: str, up: Column, name: str) -> Column:
        m = F.col(s) / F.col(n)
        between = F.sum(F.col(n) * (m - up) ** 2) / F.sum(n) - F.sum(up * (1 - up)) / F.sum(n)
        spread = F.sum(F.col(n) * up * (1 - up)) / F.sum(n)
        return F.greatest(F.lit(1.0), F.least(F.lit(1e6), spread / F.greatest(between, F.lit(1e-9)) - 1)).alias(name)

    hosts = hosts.crossJoin(F.broadcast(root))  # one row
    kh = hosts.agg(*(strength(hosts, "hn", f"hs_{h}", F.col(f"g_{h}"), f"k_{h}") for h in HEADS))
    hosts = hosts.crossJoin(F.broadcast(kh)).select(
        "__host", *(((F.col(f"hs_{h}") + F.col(f"k_{h}") * F.col(f"g_{h}")) / (F.col("hn") + F.col(f"k_{h}"))).alias(f"host_{h}") for h in HEADS)
    )
    both = paths.join(hosts, "__host")
    kp = both.agg(*(strength(both, "n", f"s_{h}", F.col(f"host_{h}"), f"k_{h}") for h in HEADS))
    return both.crossJoin(F.broadcast(kp)).select("__host", "__path", "n", *(f"{c}_{h}" for h in HEADS for c in ("s", "host", "k")))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _posterior(head: str, model: Model) -> Column:
    """The document's probability: its evidence with the rate of its path, which its own evidence is left out of."""
    own = _sigmoid(F.col(f"__{head}") + F.lit(model.base.get(head, -30.0)))
    rate = (F.col(f"s_{head}") - own + F.col(f"k_{head}") * F.col(f"host_{head}")) / (F.col("n") - 1 + F.col(f"k_{head}"))
    rate = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    return _sigmoid(F.col(f"__{head}") + F.log(rate / (1 - rate)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, rows: int = 12_000) -> DataFrame:
    """(doc_id, host, path, poor, toxic, keep) for every row of documents.

    Evidence of the document classifier (see fit) is combined with the rate of the other documents of its path, which is shrunk to
    its host's, which is shrunk to the rate of all documents (see posteriors and site). poor and toxic are posterior probabilities;
    keep says that neither exceeds `threshold` (a tie is kept). A document without a word has its path's rate. A null
    doc_id, source or lang stays in the result, source and lang as ''. Texts are read whole, however long. Repeated rows each count. Empty tables of documents
    give no row; without labels all are kept. Columns other than doc_id, text, source, lang and url are not read.
    """
    model = fit(docs, labels, rows)
    scored = settle(_evidence(docs, model, ["doc_id"]))
    return (
        scored.join(small(settle(posteriors(scored, model))), ["__host", "__path"])
        .select("doc_id", F.col("__host").alias("host"), F.col("__path").alias("path"), *(_posterior(h, model).alias(h) for h in HEADS))
        .withColumn("keep", (F.col("poor") <= threshold) & (F.col("toxic") <= threshold))
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, rows: int = 12_000) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, whatever they are called; a row without doc_id or words too.

    Every text is scored twice, once for the rates of the sites and once for itself, and never shuffled (but for the labelled
    sample). Nulls, empty and long texts, ties, repeated rows and empty tables: as in classify.
    """
    model = fit(docs, labels, rows)
    rates = settle(posteriors(_evidence(docs, model, []), model))
    return (
        _evidence(docs, model, [F.struct(*named(docs)).alias("__row")])  # as one column, whose fields clash with none
        .join(small(rates), ["__host", "__path"])
        .where((_posterior("poor", model) <= threshold) & (_posterior("toxic", model) <= threshold))
        .select("__row.*")
    )
