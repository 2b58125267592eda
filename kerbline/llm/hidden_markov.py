"""Operator 9: a hidden Markov language model.

Latent states emit word classes, a class emits words.  A word's class is a hash of it, so the tables that
every task holds have a fixed size (STATES x CLASSES) whatever the vocabulary; what grows with the corpus,
the count of every word, is exchanged by word and never gathered.

    P(word | state) = P(class | state) * (count + 1) / (tokens of the class + words of the class + 1)

Training is Baum-Welch over all training documents: each task adds up expected counts, one sum over all
tasks gives the next tables.  Rounds over the corpus go on until the likelihood of a token hardly rises
(TOLERANCE) or MOST_ROUNDS are done.  They start from tables fitted on a bounded sample (about SAMPLE_DOCS whole
documents of at most LONGEST bytes, SAMPLE_ROUNDS rounds), which only sets the starting point.

Likelihood is the scaled forward recursion, exact for every text.  Texts are cut into segments whose
transfer matrices are formed side by side; the recursion then runs over segments, so one very long text
does not take one step a word.

Edge cases: null and empty texts are the end token alone; with no training documents all counts are zero;
rows that share an id are scored one by one; a null id is never held out and comes back as null; empty
tables give empty results; other columns of the input are not read.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Route, batches, blocks_of, buffers, claim, cut, heads_of, ids_back, ids_of, lower_ascii, relay, route_for, small_batches, span_keys, word_spans

STATES, CLASSES = 4, 2048
#: Baum-Welch rounds on the sample; over the corpus at most, and the relative rise of a token's log-likelihood that ends them.
SAMPLE_ROUNDS, MOST_ROUNDS, TOLERANCE = 20, 4, 0.002
#: The bounded sample that sets the starting point: documents, about, and bytes of each at most.
SAMPLE_DOCS, LONGEST = 250, 20_000
#: Tokens of a segment whose transfer matrix is formed at once.
SEGMENT = 32
#: Class and hash of the end of a text.
END_CLASS, END_HASH = CLASSES, np.uint64(0x9B05688C2B3E6C1F)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, offsets): lower-cased words of each text, then its end."""
    claim("hidden_markov")
    data, off = buffers(column)
    data = lower_ascii(data)
    starts, ends, cuts = word_spans(data, off)
    hashes = span_keys(data, starts, ends)[0]
    to = cuts + np.arange(len(cuts))
    out = np.full(int(to[-1]), END_HASH, np.uint64)
    out[np.arange(len(hashes)) + np.searchsorted(cuts, np.arange(len(hashes)), "right") - 1] = hashes
    return out, to


def class_of(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END_HASH, END_CLASS, (hashes >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int32)


class Tables:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Tables:
        prior = emit.sum(axis=0) + 0.5
        emit = emit + 2.0 * len(prior) * prior / prior.sum()
        return Tables((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


class Layout:
    """Segments of a run of token sequences: every sequence's first token stands apart, the rest is cut in SEGMENT steps."""

    def __init__(self, off: np.ndarray):
        self.first = off[:-1]
        rest = np.diff(off) - 1
        self.parts = -(-rest // SEGMENT)
        self.doc = np.repeat(np.arange(len(rest)), self.parts)
        self.base = np.cumsum(self.parts) - self.parts
        nth = np.arange(len(self.doc)) - self.base[self.doc]
        at = self.first[self.doc] + 1 + nth * SEGMENT
        size = np.minimum(SEGMENT, off[1:][self.doc] - at)
        self.order = np.argsort(-size, kind="stable")  # long ones first, so that the live ones are a prefix
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.at, self.size = at[self.order], size[self.order]
        self.live = [int(np.searchsorted(-self.size, -t, "left")) for t in range(SEGMENT)]  # segments longer than t
        self.docs = np.argsort(-self.parts, kind="stable")
        self.active = lambda k: int(np.searchsorted(-self.parts[self.docs], -k, "left"))

    def transfer(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matrix of each segment, log of what was divided out)."""
        n, s = len(self.at), move.shape[0]
        m = np.broadcast_to(np.eye(s), (n, s, s)).copy()
        log = np.zeros(n)
        for t in range(SEGMENT):
            k = self.live[t]
            if not k:
                break
            now = (m[:k].reshape(-1, s) @ move).reshape(k, s, s)
            now *= emit[self.at[:k] + t][:, None, :]
            if t % 4 == 3 or t == SEGMENT - 1:
                scale = now.max(axis=(1, 2))
                now /= scale[:, None, None]
                log[:k] += np.log(scale)
            m[:k] = now
        return m, log

    def forward(self, m: np.ndarray, emit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(alpha before each segment, alpha after the last, log scale): alphas sum to one."""
        alpha = start * emit[self.first]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log = np.log(scale)
        before = np.empty((len(self.at), m.shape[1]))
        for k in range(int(self.parts.max(initial=0))):
            d = self.docs[: self.active(k)]
            seg = self.place[self.base[d] + k]
            before[seg] = alpha[d]
            now = np.einsum("ni,nij->nj", alpha[d], m[seg])
            scale = now.sum(axis=1)
            alpha[d] = now / scale[:, None]
            log[d] += np.log(scale)
        return before, alpha, log

    def backward(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(beta after each segment, beta at each sequence's first token), up to a factor."""
        n = m.shape[1]
        beta = np.ones((len(self.parts), n))
        after = np.empty((len(self.at), n))
        for k in range(int(self.parts.max(initial=0)) - 1, -1, -1):
            d = self.docs[: self.active(k)]
            seg = self.place[self.base[d] + k]
            after[seg] = beta[d]
            now = np.einsum("nij,nj->ni", m[seg], beta[d])
            beta[d] = now / now.sum(axis=1, keepdims=True)
        return after, beta


def log_likelihood(emit: np.ndarray, off: np.ndarray, tables: Tables) -> np.ndarray:
    """Natural log of the probability of each sequence; emit: probability of each token in each state."""
    lay = Layout(off)
    m, log = lay.transfer(emit, tables.move)
    _, _, total = lay.forward(m, emit, tables.start)
    return total + np.bincount(lay.doc, weights=log[lay.place], minlength=len(total))[: len(total)]


def expected_counts(classes: np.ndarray, off: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over the sequences."""
    return _expected(classes, off, tables)[:3]


def _expected(classes: np.ndarray, off: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts, and the log-likelihood of all sequences under the tables."""
    s = len(tables.start)
    emit = tables.emit.T[classes]
    lay = Layout(off)
    m, log = lay.transfer(emit, tables.move)
    before, _, likelihood = lay.forward(m, emit, tables.start)
    after, at_first = lay.backward(m)
    gamma = np.empty((len(classes), s))
    first = tables.start * emit[lay.first] * at_first
    first /= first.sum(axis=1, keepdims=True)
    gamma[lay.first] = first
    move = np.zeros((s, s))
    # forward within the segments, then backward
    alphas, a = [], before
    for t in range(SEGMENT):
        k = lay.live[t]
        if not k:
            break
        alphas.append(a[:k])
        a = (a[:k] @ tables.move) * emit[lay.at[:k] + t]
        a /= a.sum(axis=1, keepdims=True)
    beta = after
    for t in range(len(alphas) - 1, -1, -1):
        k = lay.live[t]
        r = emit[lay.at[:k] + t] * beta[:k]
        g = (alphas[t] @ tables.move) * r
        norm = g.sum(axis=1, keepdims=True)
        gamma[lay.at[:k] + t] = g / norm
        move += tables.move * (alphas[t].T @ (r / norm))
        b = r @ tables.move.T
        beta[:k] = b / b.sum(axis=1, keepdims=True)
    emission = np.stack([np.bincount(classes, weights=gamma[:, i], minlength=CLASSES + 1) for i in range(s)])
    return first.sum(axis=0), move, emission, float(likelihood.sum() + log.sum())


# --------------------------------------------------------------------- counts of words
def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Words of one class are in one bucket, or a class has buckets of its own, so that class totals are a row for each class or bucket."""
    cls = class_of(hashes).astype(np.int64)
    if buckets <= CLASSES:
        return cls % buckets
    own = -(-buckets // CLASSES)
    return cls * own + ((hashes >> np.uint64(20)) % np.uint64(own)).astype(np.int64)


def _block_words(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes by bucket, their buckets, inverse, token offsets)."""
    hashes, off = tokens_of(column)
    keys, inverse = np.unique(hashes, return_inverse=True)
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], bucket[order], place[inverse], off


def _send_words(route: Route):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, bucket, inverse, off = _block_words(table["text"], route.buckets)
        train = np.asarray(table["train"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        n = np.bincount(inverse, weights=np.repeat(train, np.diff(off)), minlength=len(keys)).astype("<u4")
        return _messages(key[0].as_py(), route.home(bucket), keys, n)

    return run


def _messages(block: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """One row for each of the buckets, which are in order."""
    at = heads_of(bucket)
    to = np.append(at, len(keys))[1:]
    return pa.table(
        {
            "bucket": pa.array(bucket[at], pa.int64()),
            "block": pa.array(np.full(len(at), block), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary()),
        }
    )


def _band_words(table: pa.Table, route: Route) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes of a band's messages by bucket, their buckets, inverse)."""
    keys, inverse = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]), return_inverse=True)
    bucket = _bucket(keys, route.buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], bucket[order], place[inverse]


def _merge_words(route: Route):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, bucket, inverse = _band_words(table, route)
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()])
        total = np.bincount(inverse, weights=n, minlength=len(keys)).astype("<i8")
        return _messages(key[0].as_py() * route.bands + key[1].as_py(), bucket, keys, total)

    return run


def _spread_words(route: Route):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        _, _, inverse = _band_words(table, route)
        blobs = found["counts"].to_pylist()
        total = np.frombuffer(b"".join([blobs[i] for i in np.argsort(found["bucket"].to_numpy(), kind="stable").tolist()]), "<i8")
        back, cuts = total[inverse], np.cumsum([0, *(len(x) // 8 for x in table["keys"].to_pylist())])
        return pa.table(
            {
                "block": table["block"],
                "bucket": table["bucket"],
                "counts": pa.array([back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    return run


def _count_words(key: tuple[pa.Scalar, ...], table: pa.Table, sent: str = "<u4") -> pa.Table:
    """Counts back to each block or band, and one row of class totals (block null).  sent: type of the counts sent."""
    parts = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    every = np.concatenate(parts)
    words, inverse = np.unique(every, return_inverse=True)
    n = np.concatenate([np.frombuffer(x, sent) for x in table["counts"].to_pylist()])
    total = np.bincount(inverse, weights=n, minlength=len(words)).astype("<i8")
    back, cuts = total[inverse], np.cumsum([0, *map(len, parts)])
    cls = class_of(words)
    tokens = np.bincount(cls, weights=total, minlength=CLASSES + 1).astype("<i8")
    kinds = np.bincount(cls, weights=total > 0, minlength=CLASSES + 1).astype("<i8")
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
            "bucket": pa.array([key[0].as_py()] * (len(parts) + 1), pa.int64()),
            "counts": pa.array([*(back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.stack([tokens, kinds]).tobytes()], pa.binary()),
        }
    )


def _class_rows(stream):
    for batch in stream:
        for x in batch["counts"].to_pylist():
            tokens, kinds = np.frombuffer(x, "<i8").reshape(2, -1)
            at = np.flatnonzero(tokens)
            yield pa.RecordBatch.from_pydict({"class": pa.array(at, pa.int64()), "tokens": pa.array(tokens[at], pa.int64()), "kinds": pa.array(kinds[at], pa.int64())})


# --------------------------------------------------------------------- training
def _sums(shared):
    def run(stream):
        tables = shared.value
        s = len(tables.start)
        sums = np.zeros(s + s * s + s * (CLASSES + 1) + 2)
        for table in batches(stream, "text"):
            hashes, off = tokens_of(table["text"])
            sums += np.concatenate([*[np.ravel(x) for x in _expected(class_of(hashes), off, tables)], [len(hashes)]])
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "value": pa.array(sums[at], pa.float64())})

    return run


def _split(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sums[:STATES], sums[STATES : STATES + STATES**2].reshape(STATES, STATES), sums[STATES + STATES**2 : -2].reshape(STATES, CLASSES + 1)


def _start(texts: list[str]) -> Tables:
    """Tables fitted on the sample.  The states begin with the sample's texts dealt out by what classes they share."""
    hashes, off = tokens_of(pa.array(texts, pa.string()))
    classes = class_of(hashes)
    counts = np.zeros((len(texts), CLASSES + 1))
    np.add.at(counts, (np.repeat(np.arange(len(texts)), np.diff(off)), classes), 1.0)
    weight = np.sqrt(counts) * np.log(len(texts) / np.maximum((counts > 0).sum(axis=0), 1))
    weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)
    # farthest-first centres, a few rounds of reassignment
    centre = [weight.sum(axis=0)]
    for _ in range(STATES):
        centre.append(weight[np.argmin(np.max([weight @ c / max(np.linalg.norm(c), 1e-12) for c in centre], axis=0))])
    centre = np.array(centre[1:])
    for _ in range(8):
        to = np.argmax(weight @ centre.T, axis=1)
        centre = np.array([weight[to == i].sum(axis=0) if (to == i).any() else centre[i] for i in range(STATES)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    emit = np.stack([counts[to == i].sum(axis=0) for i in range(STATES)])
    tables = Tables.from_counts(np.bincount(to, minlength=STATES).astype(float), np.eye(STATES) * 50 + 1, emit + 0.1 * counts.sum(axis=0) / STATES)
    for _ in range(SAMPLE_ROUNDS):
        tables = Tables.from_counts(*expected_counts(classes, off, tables))
    return tables


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, longest: int = LONGEST, most_rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> Tables:
    """Fit the tables on all documents of `docs`.  sample_docs and longest bound the sample that the rounds start from."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    short = own.where(F.octet_length("text") <= longest)
    share = int((1 << 30) * min(1.0, sample_docs / max(1, short.count())))
    picked = short.where(place < share).select(place.alias("place"), "text").collect()
    tables = _start([r.text for r in sorted(picked)] or [""])
    before = None
    for _ in range(most_rounds):
        shared = spark.sparkContext.broadcast(tables)  # STATES x CLASSES numbers
        rows = own.select("text").mapInArrow(_sums(shared), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(STATES + STATES**2 + STATES * (CLASSES + 1) + 2)
        for r in rows:
            sums[r["at"]] = r["value"]
        tables = Tables.from_counts(*_split(sums))
        now = sums[-2] / max(1.0, sums[-1])
        if before is not None and now - before <= tolerance * abs(before):
            break
        before = now
    return tables


def score(docs: DataFrame, is_training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents for which `is_training` holds, score all.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (unigram, add one) and score, both log10.
    """
    spark = docs.sparkSession
    tables = train(docs.where(is_training), id_col, text_col)
    flagged = docs.withColumn("__train", F.coalesce(is_training, F.lit(False)))
    _, total, n = blocks_of(flagged, id_col, text_col)
    route = route_for(spark, total / 40, n)
    with_flag = flagged.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col("__train").alias("train"))
    blocks = with_flag.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).select("block", "doc_id", "text", "train").groupBy("block")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _count_words(key, table, "<u4" if route.bands == 1 else "<i8")

    sent = blocks.applyInArrow(_send_words(route), "bucket long, block long, keys binary, counts binary")
    answers = cut(relay(sent, route, _merge_words(route), count, _spread_words(route), "block long, bucket long, counts binary", totals=True))
    tokens, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    classes = answers.where("block is null").mapInArrow(_class_rows, "class long, tokens long, kinds long")
    for r in classes.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect():
        tokens[r["class"]], kinds[r["class"]] = r["tokens"], r["kinds"]
    shared = spark.sparkContext.broadcast((tables, tokens, kinds))

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        tables, tokens, kinds = shared.value
        hashes, bucket, inverse, off = _block_words(table["text"], route.buckets)
        order = np.argsort(found["bucket"].to_numpy(), kind="stable")
        blobs = found["counts"].to_pylist()
        count = np.frombuffer(b"".join([blobs[i] for i in order.tolist()]), "<i8").astype(np.float64)
        cls = class_of(hashes)
        n, v = tokens.sum(), kinds.sum()
        base = np.log10((count + 1) / (n + v + 1))
        within = (count + 1) / (tokens[cls] + kinds[cls] + 1)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x[inverse], off[:-1])

        model = log_likelihood(tables.emit.T[cls[inverse]], off, tables) / np.log(10) + per_doc(np.log10(within))
        return pa.table(
            {
                "doc_id": ids_back(ids_of(table["doc_id"])),
                "n_tokens": pa.array(np.diff(off), pa.int64()),
                "n_known": pa.array(per_doc((count > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(off) - 1, int(n)), pa.int64()),
                "base_score": pa.array(per_doc(base), pa.float64()),
                "score": pa.array(model, pa.float64()),
            }
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(last, schema)
