"""Benchmark decontamination by latent semantic retrieval and exact confirmation.

Texts are tokenised once; what later passes need is stored. They are cut into blocks of words, and a
block's TF-IDF row has hashed features. A distributed randomised SVD of all blocks (one pass, whose sums
per feature have fixed size) gives a latent space, which is whitened so that frequent words don't dominate
it. Each two consecutive blocks make a passage.

A place is a candidate for an item if it holds as many of the item's rare words as a match has at
least, and if one of its passages reaches a cosine with the item in the latent space. Items that
fill less than a passage may lie anywhere in that space, so for them the exact bound alone decides.
The longest common subsequence of words confirms: a high share of the item is a leak, a lower one is a
paraphrase if the item's answer, its last sentence, is there as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import stored
from lodeworks.llm.tokens import slices

#: Hashed features, latent dimensions, words in a block, bytes of text and of benchmark items at a time.
FEATURES, RANK, BLOCK, SLICE_BYTES, ITEM_BYTES = 8192, 24, 16, 1_500_000, 16_000_000
#: A word is rare if its feature is in at most this share of all blocks, or more where places with enough rare words aren't
#: so unlikely (a negative logarithm). Items of fewer words than SHORT are candidates whatever their cosine.
RARE, UNLIKELY, SHORT = 0.02, 7.0, 32
_ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_ANSWER = regex.compile(r"(?<=[.!?。！？])\s+|[\n\r]+")


def plain_words(tokens: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all tokens, lower-cased runs of letters and digits, and how many each token has.

    Letters of scripts without blanks are words of their own.
    """
    plain = pc.utf8_lower(tokens.cast(pa.large_string()))
    plain = pc.replace_substring_regex(plain, r"[^\pL\pN]+", " ")
    plain = pc.replace_substring_regex(plain, _ALONE, r" \0 ")
    parts = pc.ascii_split_whitespace(plain)  # blanks at either end give an empty part
    words, owner = parts.flatten(), np.repeat(np.arange(len(tokens)), np.diff(parts.offsets.to_numpy()))
    full = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(full)), np.bincount(owner[full], minlength=len(tokens))


def word_table(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different plain words, the number among them of each word of all texts, and words per text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten().dictionary_encode()
    words, size = plain_words(flat.dictionary)
    named = words.dictionary_encode()
    token = flat.indices.to_numpy()
    n = size[token]  # words of each token of the texts
    ends = np.concatenate(([0], np.cumsum(n)))
    first = (np.cumsum(size) - size)[token]
    at = named.indices.to_numpy()[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
    return named.dictionary, at, np.diff(ends[parts.offsets.to_numpy()])


_POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(1 << 12)], np.uint64)


def features(names: pa.Array) -> np.ndarray:
    """A hashed feature of each word."""
    edges = np.frombuffer(names.buffers()[1], "<i8")[names.offset : names.offset + len(names) + 1]
    if not len(names):
        return np.zeros(0, np.int32)
    letters = np.frombuffer(names.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].astype(np.uint64)
    start = edges[:-1] - edges[0]
    size = np.diff(edges)
    place = np.arange(len(letters)) - np.repeat(start, size)
    terms = np.append((letters + np.uint64(1)) * _POWERS[place % len(_POWERS)], np.uint64(0))
    total = np.where(size > 0, np.add.reduceat(terms, start), 0).astype(np.uint64)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return ((total >> np.uint64(32)) % np.uint64(FEATURES)).astype(np.int32)


def block_edges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and the blocks of each text."""
    blocks = -(-counts // BLOCK)
    first = np.cumsum(counts) - counts
    start = np.repeat(first, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    return start, blocks


def block_table(start: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """The features of each block, a row of BLOCK each; unused places hold one past the last feature."""
    table = np.full((len(start), BLOCK), FEATURES, np.uint16)
    table[np.arange(BLOCK) < np.diff(np.append(start, len(feature)))[:, None]] = feature
    return table


def _row_sums(weighted: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of each block's words; the row past the last feature is zero."""
    out = weighted[table[:, 0]]
    for k in range(1, BLOCK):
        out += weighted[table[:, k]]
    return out


def _with_zero(weights: np.ndarray) -> np.ndarray:
    return np.append(weights, np.zeros((1, weights.shape[1]), weights.dtype), axis=0)


#: What is stored of each slice of texts with words: ids and words of each text (64 and 32 bits), different words parted by
#: blanks, their features (16 bits), and which of them each word is (32 bits).
STORED = "ids array<long>, counts binary, names string, features binary, at binary"


def tokenised(docs: DataFrame) -> DataFrame:
    """A row as STORED says for each slice of ``docs`` (doc_id, text)."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names, at, counts = word_table(part.column("text"))
                if len(at):
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("doc_id"))
                    plain = [counts.astype("<i4").tobytes(), " ".join(names.to_pylist()), features(names).astype("<u2").tobytes(), at.astype("<u4").tobytes()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([x]) for x in plain)], ["ids", "counts", "names", "features", "at"])

    return docs.mapInArrow(made, STORED)


def _parts(batches):
    """(row, words of each text, which word each is, feature of each) of each slice."""
    for batch in batches:
        for k in range(len(batch)):
            counts, feature, at = (np.frombuffer(batch.column(c)[k].as_buffer(), d) for c, d in (("counts", "<i4"), ("features", "<u2"), ("at", "<u4")))
            yield batch.slice(k, 1), counts.astype(np.int64), at, feature[at]


def block_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Blocks that hold each feature, and all blocks."""

    def counted(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, counts, _, feature in _parts(batches):
            table = block_table(block_edges(counts)[0], feature)
            n += len(table)
            table.sort(axis=1)
            new = np.ones(table.shape, bool)
            new[:, 1:] = table[:, 1:] != table[:, :-1]
            total += np.bincount(table[new], minlength=FEATURES + 1)[:FEATURES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate(([n], total)))], ["feature", "n"])

    plain = words.select("counts", "features", "at")
    rows = plain.mapInArrow(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for r in rows:  # one for each feature
        out[r.feature + 1] = r.n
    return out[1:], int(out[0])


def _sketch(words: DataFrame, idf: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'(A test) of the TF-IDF matrix A of all blocks."""
    spark, rank = words.sparkSession, test.shape[1]
    shared = spark.sparkContext.broadcast((idf, _with_zero((idf[:, None] * test).astype(np.float32))))

    def multiplied(batches):
        idf, weighted = shared.value
        total = np.zeros((FEATURES + 1, rank))
        for _, counts, _, feature in _parts(batches):
            table = block_table(block_edges(counts)[0], feature)
            rows = _row_sums(weighted, table)
            flat = table.ravel()
            order = np.argsort(flat, kind="stable")
            there, begin = np.unique(flat[order], return_index=True)
            owner = order // BLOCK
            for c, column in enumerate(np.ascontiguousarray(rows.T)):
                total[there, c] += np.add.reduceat(column[owner], begin)
        total = total[:FEATURES] * idf[:, None]
        values = [pa.array(total[:, c].astype(np.float32)) for c in range(rank)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), *values], ["feature", *(f"y{c}" for c in range(rank))])

    schema = "feature long, " + ", ".join(f"y{c} float" for c in range(rank))
    sums = words.select("counts", "features", "at").mapInArrow(multiplied, schema).groupBy("feature").agg(*[F.sum(f"y{c}").alias(f"y{c}") for c in range(rank)])
    out = np.zeros((FEATURES, rank))
    for r in sums.collect():  # one for each feature
        out[r[0]] = r[1:]
    return out


def latent_space(words: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x dimension) that take term counts into the whitened latent space, and each feature's share of blocks.

    The sketch Z = A'(A T) with a random orthonormal T gives A'A as Z (T'Z)^-1 Z', whose
    singular values and vectors are those of a small matrix.
    """
    seen, n = block_frequencies(words)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    test, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, RANK)))
    image = _sketch(words, idf, test)
    core = test.T @ image
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-7 * max(value.max(), 1e-300)
    root = image @ (vector[:, keep] / np.sqrt(value[keep]))
    left, size, _ = np.linalg.svd(root, full_matrices=False)  # sizes: singular values of A
    keep = size > 1e-6 * max(size.max(initial=0), 1e-300)
    return (idf[:, None] * left[:, keep] / size[keep]).astype(np.float32), seen / max(n, 1)


def common_subsequence(masks: dict, size: int, words) -> int:
    """Length of the longest common subsequence; ``masks``: the places of each word of the item, as bits."""
    full = (1 << size) - 1
    state = full
    get = masks.get
    for w in words:
        m = get(w)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def need(rare, size: int, paraphrase: float):
    """How many of an item's rare words are there at least where a share of the item is found in order."""
    return np.ceil(rare - (1 - paraphrase) * size - 1e-9)


def rarity(shares: np.ndarray, different: np.ndarray, blocks: int, paraphrase: float) -> float:
    """Up to which share of all blocks an item's words count as rare: RARE, or more where too many places would have the needed ones.

    ``shares``: of the item's words; ``different``: of its different words; ``blocks``: of a place.
    """
    best = (-1.0, RARE)
    for t in [RARE, *np.unique(shares[shares > RARE]).tolist()]:
        least = float(need((shares <= t).sum(), len(shares), paraphrase))
        usual = max(1e-9, blocks * float(different[different <= t].sum()))
        unlikely = least * np.log(least / usual) - least + usual if least > usual else 0.0  # bound on a Poisson tail
        best = max(best, (unlikely, t))
        if t == RARE and unlikely >= UNLIKELY:
            break
    return best[1] if best[0] > 0 else float(shares.max())


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids, texts, weights, shares, paraphrase):
        self.ids, own, answers = [], [], []
        for i, t in zip(ids, texts):
            words = self._words(t)
            if words:
                self.ids.append(i)
                own.append(words)
                answers.append(self._words([s for s in _ANSWER.split(t) if self._words(s)][-1]))
        self.vocabulary = sorted({w for ws in own + answers for w in ws})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.words = [[number[w] for w in ws] for ws in own]
        self.answers = [[number[w] for w in ws] for ws in answers]
        feature = features(pa.array(self.vocabulary, pa.large_string()))
        # an item of which a share is found in order has so many of its rare words there, at least
        share = shares[feature]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.reach = -(-self.size // BLOCK)
        limit = [rarity(share[w], share[np.unique(w)], 2 * r + 2, paraphrase) for w, r in zip(self.words, self.reach.tolist())]
        self.need = np.array([need((share[w] <= t).sum(), len(w), paraphrase) for w, t in zip(self.words, limit)], np.int32)
        pairs = sorted({(w, k) for k, ws in enumerate(self.words) for w in ws if share[w] <= limit[k]})
        self.holders = np.array([k for _, k in pairs], np.int64)
        self.first_holder = np.searchsorted([w for w, _ in pairs], np.arange(len(self.vocabulary) + 1))
        vectors = [weights[feature[w]].sum(0) for w in self.words]
        self.vectors = np.array(vectors, np.float32).reshape(len(own), weights.shape[1])
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)

    @staticmethod
    def _words(text: str) -> list[str]:
        names, at, _ = word_table(pa.array([text]))
        return names.take(pa.array(at)).to_pylist()

    def places(self, number: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first, last) of each run of blocks around which there are as many rare words of the item as a match needs.

        Around a block: from ``reach`` before to ``reach`` + 1 behind it. Only words that are there are looked at.
        """
        some = np.flatnonzero(number >= 0)
        n = self.first_holder[number[some] + 1] - self.first_holder[number[some]]
        at = np.repeat(self.first_holder[number[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, where = self.holders[at], np.repeat(block[some], n)
        order = np.argsort(item.astype(np.uint16) if len(self.ids) < 1 << 16 else item, kind="stable")  # blocks ascend already
        item, where = item[order], where[order]
        one = np.arange(len(item))
        other = one + self.need[item] - 1  # the last of as many words as are needed
        one = one[other < len(item)]
        other = other[other < len(item)]
        fits = (item[other] == item[one]) & (where[other] - where[one] <= 2 * self.reach[item[one]] + 1)
        one, other = one[fits], other[fits]
        k = item[one]
        first, last = np.maximum(where[other] - self.reach[k] - 1, 0), np.minimum(where[one] + self.reach[k], blocks - 1)
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (first[1:] > last[:-1] + 1)))[: len(k)]
        return k[new], first[new], last[np.append(new[1:], len(k))[: len(new)] - 1]

    def may_hold(self, k: int, words: list[int], paraphrase: float) -> bool:
        """Whether as many of the item's words are among the given ones as a match needs, in whatever order."""
        some = set(words)
        return sum(w in some for w in self.words[k]) >= paraphrase * len(self.words[k])

    def confirm(self, k: int, words: list[int], leak: float, paraphrase: float, answer: float):
        """(share of the item, share of the answer) in the given words' numbers, or None."""
        if not self.may_hold(k, words, paraphrase):
            return None
        item = self.words[k]

        def share(target):
            masks: dict = {}
            for place, w in enumerate(target):
                masks[w] = masks.get(w, 0) | 1 << place
            return common_subsequence(masks, len(target), words) / max(1, len(target))

        found = share(item)
        if found < paraphrase:
            return None
        said = share(self.answers[k])
        return (found, said) if found >= leak or said >= answer else None


def search(words: DataFrame, weights: np.ndarray, items: Items, cosine: float, leak: float, paraphrase: float, answer: float) -> DataFrame:
    """Every text and item of a match, from ``words`` as ``tokenised`` makes them."""
    shared = words.sparkSession.sparkContext.broadcast((weights, items))

    def matched(batches):
        weights, items = shared.value
        weights, vocabulary = _with_zero(weights), pa.array(items.vocabulary, pa.string())
        for row, counts, at, feature in _parts(batches):
            ids = row.column("ids")[0].values
            number = pc.fill_null(pc.index_in(pc.split_pattern(row.column("names"), " ").flatten(), vocabulary), -1).to_numpy()[at]
            start, blocks = block_edges(counts)
            doc = np.repeat(np.arange(len(counts)), blocks)
            first = np.cumsum(counts) - counts
            latent = _row_sums(weights, block_table(start, feature))
            block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
            best: dict = {}
            reach: dict = {}
            for k, b_low, b_high, c in _near(latent, doc, items, number, block, cosine):
                d = int(doc[b_low])
                size, begin, end = len(items.words[k]), int(first[d]), int(first[d] + counts[d])
                around = number[max(begin, int(start[b_low]) - size) : min(end, int(start[b_high]) + 2 * BLOCK + size)].tolist()
                if not items.may_hold(k, around, paraphrase):
                    continue
                for at_b in start[b_low : b_high + 1].tolist():
                    low, high = max(begin, at_b - size), min(end, at_b + 2 * BLOCK + size)
                    if low < reach.get((d, k), -1):  # runs into the place searched last: search on from its item's length before
                        low = max(low, reach[d, k] - 2 * size)
                        if high <= reach[d, k]:
                            continue
                    reach[d, k] = high
                    got = items.confirm(k, number[low:high].tolist(), leak, paraphrase, answer)
                    if got and got[0] > best.get((d, k), (0,))[0]:
                        best[d, k] = (*got, float(c), low - begin, high - begin)
            out = [(ids[d].as_py(), items.ids[k], *v) for (d, k), v in best.items()]
            columns = zip(*out) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "item_share", "answer_share", "cosine", "first_word", "last_word"])

    return words.mapInArrow(matched, "doc_id long, item_id long, item_share double, answer_share double, cosine double, first_word long, last_word long")


def passages(latent: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Unit vectors of all blocks, each with the one that follows in its document."""
    out = latent.copy()
    out[:-1] += latent[1:] * (doc[1:] == doc[:-1])[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _near(latent: np.ndarray, doc: np.ndarray, items: Items, number: np.ndarray, block: np.ndarray, cosine: float):
    """(item, first and last passage, largest cosine) of all candidate places, each within one text; by item, then place."""
    item, low, high = items.places(number, block, len(doc))
    n = high - low + 1
    place = np.repeat(np.arange(len(item)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(b):
        return
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[b[1:]] != doc[b[:-1]])))
    close = np.einsum("ij,ij->i", items.vectors[item[place]], passages(latent, doc)[b])
    best, item = np.maximum.reduceat(close, new), item[place[new]]
    kept = (best >= cosine) | (items.size[item] < SHORT)
    yield from zip(*(x[kept].tolist() for x in (item, b[new], b[np.append(new[1:], len(b)) - 1], best)))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.1,
    leak: float = 0.8,
    paraphrase: float = 0.6,
    answer: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_share, answer_share, cosine, first_word, last_word) of each document that holds an item.

    ``cosine``: what a passage of a place has to reach with an item of SHORT words or more; the largest one is returned. The
    place is a range of the document's words around the item. Null and empty texts
    hold nothing and are no items; identical rows give identical rows, of equally good places the first counts; an empty table on
    either side gives no rows. Further columns aren't read. Items go through in blocks of bounded size, each against all documents.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = stored(tokenised(own), "words")
    weights, shares = latent_space(words)
    wanted = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // ITEM_BYTES
    out = None
    for k in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        found = search(words, weights, Items([r.item_id for r in some], [r.text for r in some], weights, shares, paraphrase), cosine, leak, paraphrase, answer)
        out = found if out is None else out.unionAll(found)
    return out
