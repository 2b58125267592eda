"""Operator 1: language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text yields longest matches.  A text, as its lower-cased words
parted by single spaces, is parsed greedily into the longest phrases that occur in a language's text; the language
that needs the fewest, normalised as phrases * log2(training bytes) / bytes parsed, wins.  Phrases run across words.

A greedy parse is one run of the automaton.  All texts of a batch are parsed abreast, in stretches of STRETCH bytes:
a stretch first runs as if a phrase began with it; then it runs again from the state that the stretch before it
really ends in, until both runs are in one state, from where on they are the same.  The counts are those of the
parse of the whole text.

The classifier is fitted on a bounded sample of the labelled rows: whole texts of at most `longest` bytes, in the
order of a hash of their id, until a language has `sample_bytes`; a language without a text that short learns from
its shortest one.  Texts without a letter teach nothing and don't count.  All parse tables together take about
`model_bytes`: with many languages each has a smaller sample.  Prediction covers whole texts.

Edge cases: a text that is null or has no letter (Unicode category L) is `und` with score 0, as is every text when
nothing is labelled; empty tables give empty results; ties go to the first language by name; rows that share an id
are judged one by one; a null id counts as not held out; other columns of the input are not read, or passed on as
they are: a judged column whose name one of them has takes underscores until it is free.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, batches, claim, small_batches, trim

#: Bytes of text per language that are learned from, about, and of one text at most.
SAMPLE_BYTES, LONGEST = 32_000, 4_000
#: Bytes of the parse tables of all languages, about, and the number of languages that is too large for them.
MODEL_BYTES, MOST_LANGUAGES = 256_000_000, 2_000
#: Bytes of a stretch, and stretches that are parsed abreast.
STRETCH, LANES = 128, 16_384
UNKNOWN = "und"
_STATE = (1 << 28) - 1


class _Letters(dict):
    """A table for str.translate: letters stay, all else is a space."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 0x20
        return self[code]


_letters = _Letters()


def normalised(text: str | None) -> bytes:
    """What is parsed of a text: its words in lower case between single spaces; nothing if it has no letter."""
    words = text.lower().translate(_letters).split() if text else []
    return " ".join(["", *words, ""]).encode() if words else b""


def suffix_automaton(text: bytes, codes: np.ndarray) -> np.ndarray:
    """Transitions [state, code] of the suffix automaton of text; state 1 is the root, 0 means none."""
    width = int(codes.max()) + 1
    size = 2 * len(text) + 3
    link, length = [0] * size, [0] * size
    last, n = 1, 2
    step: list[dict[int, int]] = [{} for _ in range(size)]
    for c in codes[np.frombuffer(text, np.uint8)].tolist():
        cur, n = n, n + 1
        length[cur] = length[last] + 1
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin, n = n, n + 1
                length[twin], link[twin] = length[p] + 1, link[q]
                step[twin] = step[q].copy()
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    go = np.zeros((n, width), np.int32)
    for s in range(1, n):
        for c, t in step[s].items():
            go[s, c] = t
    return go


def _parser(go: np.ndarray) -> np.ndarray:
    """The greedy parse as one table [state * width + code]: the next state times width and, above it, the phrases that end.

    Where the automaton has no way on, the phrase ends before the byte, which begins the next; a byte that the
    language lacks is a phrase of its own.
    """
    n, width = go.shape
    if n * width > _STATE:
        raise ValueError("the sample of a language is too large for the parse table: lower sample_bytes")
    again = go[1]
    ends = (np.arange(n)[:, None] != 1).astype(np.int64) + (again == 0)[None, :]
    stuck = go == 0
    state = np.where(stuck, np.where(again == 0, 1, again)[None, :], go).astype(np.int64)
    return (state * width | np.where(stuck, ends, 0) << 28).astype(np.uint32).ravel()


class Model:
    def __init__(self, samples: dict[str, bytes]):
        """samples: normalised text per language."""
        self.languages = sorted(samples)
        used = np.zeros(256, bool)
        for text in samples.values():
            used[np.frombuffer(text, np.uint8)] = True
        self.codes = np.where(used, np.cumsum(used), 0).astype(np.uint8)
        self.width = int(self.codes.max()) + 1
        self.tables = [_parser(suffix_automaton(samples[k], self.codes)) for k in self.languages]
        self.bits = np.log2([max(2, len(samples[k])) for k in self.languages])

    def parse(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text, a row, in each language, a column."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.codes[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.cumsum(size) - size
        parts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = off[owner] + nth * STRETCH
        lens = np.minimum(STRETCH, off[owner] + size[owner] - at)
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        for k, table in enumerate(self.tables):
            carry = self.width
            for a in range(0, len(owner), LANES):
                b = min(a + LANES, len(owner))
                counts, ends = self._stretches(table, flat, at[a:b], lens[a:b], nth[a:b] > 0, carry)
                carry = int(ends[-1])
                # an unfinished phrase at the end of a text counts
                counts += (ends != self.width) & (nth[a:b] + 1 == parts[owner[a:b]])
                out[:, k] += np.bincount(owner[a:b], weights=counts, minlength=len(texts)).astype(np.int64)
        return out

    def _stretches(self, table: np.ndarray, flat: np.ndarray, at: np.ndarray, lens: np.ndarray, goes_on: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each stretch, the state it ends in).  goes_on: it follows the one before it; carry: where what is before the first ends."""
        n, root = len(at), self.width
        order = np.argsort(-lens, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first, size = at[order], lens[order]
        states, counts = np.zeros((STRETCH, n), np.uint32), np.zeros((STRETCH, n), np.int32)
        state, count = np.full(n, root, np.uint32), np.zeros(n, np.int32)
        for t in range(int(size[0])):
            m = int(np.searchsorted(-size, -t, "left"))
            v = table[state[:m] + flat[first[:m] + t]]
            state[:m] = v & np.uint32(_STATE)
            count[:m] += (v >> np.uint32(28)).astype(np.int32)
            states[t, :m], counts[t, :m] = state[:m], count[:m]
        ends, total, used = state[place].astype(np.int64), count[place].astype(np.int64), np.full(n, root, np.int64)
        while True:
            before = np.concatenate([[carry], ends[:-1]])
            live = np.flatnonzero(goes_on & (before != used))
            if not len(live):
                return total, ends
            used[live] = before[live]
            now, done = before[live].astype(np.uint32), np.zeros(len(live), np.int32)
            for t in range(STRETCH):
                keep = lens[live] > t
                if not keep.all():  # these end in another state than they did
                    ends[live[~keep]], total[live[~keep]] = now[~keep], done[~keep]
                    live, now, done = live[keep], now[keep], done[keep]
                if not len(live):
                    break
                v = table[now + flat[at[live] + t]]
                now = v & np.uint32(_STATE)
                done = done + (v >> np.uint32(28)).astype(np.int32)
                lane = place[live]
                met = states[t, lane] == now
                if met.any():  # from here on both runs are one
                    ahead = done[met] - counts[t, lane[met]]
                    counts[t:, lane[met]] += ahead
                    total[live[met]] += ahead
                    live, now, done, lane = live[~met], now[~met], done[~met], lane[~met]
                states[t, lane], counts[t, lane] = now, done
            ends[live], total[live] = now, done


def _predict(broadcast, text_col: str, names_out: list[str], judged: list[str]):
    """Judge each batch; names_out: the columns of the input that are passed on."""

    def run(stream):
        model = broadcast.value
        claim("language_id")
        names, k = model.languages, len(model.languages)
        for table in batches(stream, text_col):
            texts = [normalised(x) for x in table[text_col].to_pylist()]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            known = (size > 0) & (k > 0)
            cost = model.parse(texts).T * model.bits[:, None] / np.maximum(size, 1) if k else np.zeros((1, len(known)))
            best = cost.argmin(axis=0)
            ranked = np.sort(cost, axis=0)
            second = ranked[1] if k > 1 else np.full(len(known), np.inf)
            with np.errstate(invalid="ignore"):
                score = np.where(known & (second > 0), 1 - ranked[0] / np.where(second > 0, second, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *[table[c] for c in names_out],
                    pa.array([names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                    pa.array(np.clip(score, 0, 1), pa.float64()),
                    pa.array(np.where(known, ranked[0], np.nan), pa.float64(), mask=~known),
                ],
                names=[*names_out, *judged],
            )

    return run


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_bytes: int = SAMPLE_BYTES,
    longest: int = LONGEST,
    model_bytes: int = MODEL_BYTES,
) -> Model:
    """Learn from a bounded sample of the labelled rows: the same rows whatever the partitioning.

    sample_bytes: of text per language; the last text that is taken may go beyond it.  longest: texts of more
    bytes are not sampled, unless a language has no shorter one with a letter.  model_bytes: of all parse tables.
    """
    size = F.octet_length(text_col)
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    lettered = F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    rows = labelled.where(lettered).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), size.alias("size"), place.alias("place"))
    short = F.col("size") <= longest
    known = rows.groupBy("lang").agg(F.sum(F.when(short, F.col("size"))).alias("bytes")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the label column holds something else")
    # a share of each language's bytes, by a hash of the row: about twice the sample comes to the driver
    shares = [(r.lang, int((1 << 30) * min(1.0, 2 * sample_bytes / r.bytes)) + 1) for r in known if r.bytes]
    taken = []
    if shares:
        below = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, below long"))  # MOST_LANGUAGES rows at most
        taken = rows.where(short).join(below, "lang").where("place < below").select("lang", "place", "text").collect()
    # languages of long texts alone: one text of each
    rest = [r.lang for r in known if not r.bytes]
    if rest:
        taken += rows.where(F.col("lang").isin(rest)).groupBy("lang").agg(F.min(F.struct("size", "place", "text")).alias("least")).select("lang", "least.place", "least.text").collect()
    ordered = sorted(taken, key=lambda r: (r.place, hashlib.sha256(r.text.encode()).digest()))
    texts = [(r.lang, found.strip()) for r in ordered if (found := normalised(r.text))]
    # a table has up to two states a byte, with four bytes for each byte value that occurs
    width = len(set().union(*(set(t) for _, t in texts))) + 2
    most = min(sample_bytes, model_bytes // (8 * width * max(1, len(known))))
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for lang, text in texts:
        if held.get(lang, 0) < most:
            samples.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
    model = Model({k: b" " + b" ".join(t) + b" " for k, t in samples.items()})
    trim()
    return model


#: Columns that a judged table has besides its own.
JUDGED = ("lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """lang_pred, score (how far the best language is ahead, 0 to 1) and bits_per_byte for every document.

    columns: of the input, to pass on; the id alone if not given.
    """
    columns = [id_col] if columns is None else columns
    judged = added(columns, *JUDGED)
    small_batches(docs.sparkSession)
    own = docs.select(*dict.fromkeys([*columns, text_col]))
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*[docs.schema[c] for c in columns], *[T.StructField(c, k) for c, k in zip(judged, kinds, strict=True)]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table a language, whose size the sample bounds
    return own.mapInArrow(_predict(shared, text_col, columns, judged), schema)
