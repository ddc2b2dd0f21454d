"""Removal of sentence spans that occur before, in the same or another document.

A sentence ends at a stop or a line end. Longer ones are cut further, behind words whose hash is the
least of five (of equal ones, each), so that a passage that begins and ends within other
sentences is cut at the same words in all its copies. From each such part on, and up to each, the
shortest run of two or more consecutive parts that holds ``min_words`` words is hashed, with 96 bits. Runs
are joined over all documents; every occurrence but the first of a run loses its parts. Runs
from both sides cover each part of a repeated passage that holds as many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lodeworks.llm.common import drop_stored, stored, unused
from lodeworks.llm.tokens import slices

SLICE_BYTES = 1_000_000
#: Code points that part words besides ASCII blanks, that end lines, and that are words of their own (scripts without blanks).
_BLANK = r"\x00\x01\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_LINE = r"\n\r\x{2028}\x{2029}"
_ALONE = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_STOP = r"""[.!?。！？]["'»”’)\]]*$"""
_MARK = "\x01"
_TOKEN = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08X}", rf"[{_ALONE}]|[^\x09-\x0D\x20{_BLANK}{_LINE}{_ALONE}]+"))
#: Odd multipliers of the two halves of a run's hash, and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _words(texts: pa.Array):
    """Different words of all texts, which of them each word is, words of each text, and whether a sentence ends behind each word."""
    plain = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    plain = pc.replace_substring_regex(plain, f"[{_BLANK}]", " ")
    plain = pc.replace_substring_regex(plain, f"[{_LINE}]+", f" {_MARK} ")
    plain = pc.replace_substring_regex(plain, f"([{_ALONE}])", r" \1 ")
    parts = pc.ascii_split_whitespace(plain)
    flat = parts.flatten().dictionary_encode()
    names, at = flat.dictionary, flat.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.binary_length(names).to_numpy() > 0  # an empty text splits into one empty word
    mark = pc.equal(names, _MARK).to_numpy(zero_copy_only=False)
    at, owner = at[full[at]], owner[full[at]]
    ends = pc.match_substring_regex(names, _STOP).to_numpy(zero_copy_only=False)[at]
    ends[:-1] |= mark[at[1:]]
    kept = ~mark[at]
    return names, at[kept], np.bincount(owner[kept], minlength=len(texts)), ends[kept]


def _hashes(names: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, names.to_pylist())), "<u8").reshape(-1, 2)


def _cuts(rank: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts begin and end, as ascending places among all words, and the text of each part."""
    n = len(rank)
    text = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(n + 1, bool)
    new[1:-1] = ends[:-1] | (text[1:] != text[:-1])
    sentence = np.cumsum(new[:-1])
    mid = rank[2:-2]
    least = (mid <= rank[:-4]) & (mid <= rank[1:-3]) & (mid <= rank[3:-1]) & (mid <= rank[4:]) & (sentence[4:] == sentence[:-4])
    new[np.flatnonzero(least) + 3] = True
    places = np.flatnonzero(new)
    return places, text[places[:-1]]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _runs(places: np.ndarray, text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last part of each different run, by text and place."""
    parts = len(text)
    own = np.arange(parts)
    last = np.maximum(np.searchsorted(places, places[:-1] + min_words) - 1, own + 1)  # shortest run from each on
    first = np.minimum(np.searchsorted(places, places[1:] - min_words, "right") - 1, own - 1)  # shortest run up to each
    on = np.flatnonzero(last < parts)
    on = on[text[last[on]] == text[on]]
    up = np.flatnonzero(first >= 0)
    up = up[text[first[up]] == text[up]]
    return np.divmod(np.unique(np.concatenate((on * parts + last[on], first[up] * parts + up))), max(parts, 1))


def runs(texts: pa.Array, min_words: int):
    """(text, number in the text, hash) of each different run, in order; the hash in two columns.

    The hash of a run is a polynomial of its words' hashes, so sums over a prefix give that of all runs.
    """
    names, at, counts, ends = _words(texts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros((0, 2), np.uint64)
    word = _hashes(names)
    places, text = _cuts(word[at, 0], counts, ends)
    i, j = _runs(places, text, min_words)
    low, high = places[i], places[j + 1]
    span = np.empty((len(i), 2), np.uint64)
    for half, base in enumerate(_BASES):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word[at, half] * _powers(base, len(at)), dtype=np.uint64)))
        value = (total[high] - total[low]) * _powers(pow(base, -1, 1 << 64), len(at) + 1)[low]
        span[:, half] = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    of = text[i]
    return of, np.arange(len(i)) - np.searchsorted(of, of), span


def _again(text: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Whether a run was there before in its text."""
    order = np.lexsort((np.arange(len(text)), span[:, 1], span[:, 0], text))
    same = np.zeros(len(text), bool)
    a, b = order[:-1], order[1:]
    same[b] = (text[a] == text[b]) & (span[a] == span[b]).all(1)
    return same


def run_places(texts: list[str], min_words: int) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Of each text: where each part ends, as characters, with the blanks behind it, and first and last part of each run.

    Together the parts cover a text.
    """
    names, at, counts, ends = _words(pa.array(texts, pa.string()))
    own: list[list[int]] = [[] for _ in texts]
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(at):
        places, text = _cuts(_hashes(names)[at, 0], counts, ends)
        first = np.cumsum(counts) - counts
        for k, place in zip(text.tolist(), (places[1:] - first[text]).tolist()):
            own[k].append(place)
        i, j = _runs(places, text, min_words)
        opened = np.searchsorted(text, text[i])
        for k, a, b in zip(text[i].tolist(), (i - opened).tolist(), (j - opened).tolist()):
            found[k].append((a, b))
    for k, text in enumerate(texts):
        begins = [m.start() for m in _TOKEN.finditer(text)]
        if len(begins) != counts[k]:
            raise ValueError("words and places differ")
        begins.append(len(text))
        own[k] = [begins[p] for p in own[k]] or [len(text)]
    return list(zip(own, found))


def hashed_runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_key, a, b, run) of all runs. doc, text_key: see ``_key``; a, b: 96 bits of hash; run: four times its number,
    two more if it was there before in its text, one more if the document has no id."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                text, number, span = runs(part.column("text"), min_words)
                take = pa.array(text)
                number = 4 * number + 2 * _again(text, span) + part.column("none").to_numpy(zero_copy_only=False)[text]
                columns = [part.column("doc").take(take), part.column("text_key").take(take), span[:, 0].view(np.int64), (span[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32), number.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "text_key", "a", "b", "run"])

    doc, text_key = _key(id_col, text_col)
    keyed = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.col(id_col).isNull().alias("none"), F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(made, "doc long, text_key int, a long, b int, run int")


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What rows with one id, or without one, are told apart by: the id or a hash of the text, and another hash of the text."""
    text = F.col(text_col).cast("string")
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)), F.hash(text)


def repeated_runs(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_key, run, first_doc_id) of each run that isn't the first of its kind; run: its number in the text.

    The first is in the document of the smallest id (a null id comes before all) and the
    foremost there. Rows that share an id count as one document to each other: only
    repeats within each of them, or of documents with smaller ids, count.
    """
    spans = stored(hashed_runs(docs, min_words, id_col, text_col), "spans")
    none, again = (F.col("run").bitwiseAND(bit) > 0 for bit in (1, 2))
    order = F.when(none, F.lit(-(1 << 63))).otherwise(F.col("doc"))
    origins = spans.groupBy("a", "b").agg(F.min(order).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    origins = stored(origins.select("a", "b", "origin"), "origins")  # read anew, a frequent span's rows can be split
    late = spans.join(origins, ["a", "b"]).where(again | (order > F.col("origin")))
    first = F.when(F.col("origin") > -(1 << 63), F.col("origin"))
    out = stored(late.select("doc", "text_key", F.shiftright("run", 2).alias("run"), first.alias("first_doc_id")), "late")
    drop_stored(spans)
    drop_stored(origins)
    return out


def _removed(ends: list[int], runs_of: list[tuple[int, int]], spans) -> list[tuple[int, int, list]]:
    """(begin, end, ids of first documents) of what is removed, runs that touch or overlap as one."""
    ends = [0, *ends]
    out = []
    for s in sorted(spans, key=lambda s: s["run"]):
        first, last = runs_of[s["run"]]
        begin, end, origin = ends[first], ends[last + 1], s["first_doc_id"]
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
            if origin not in out[-1][2]:
                out[-1][2].append(origin)
        else:
            out.append([begin, end, [origin]])
    return out


def _places(batch: pa.RecordBatch, text_col: str, spans_col: str, min_words: int):
    """(row, text, what is removed of it) of each row with spans."""
    rows = pc.indices_nonzero(pc.fill_null(pc.list_value_length(batch.column(spans_col)), 0))
    some = pa.RecordBatch.from_arrays([rows, batch.column(text_col).take(rows), batch.column(spans_col).take(rows)], ["row", "text", "spans"])
    for part in slices(some, "text", SLICE_BYTES):
        texts = part.column("text").to_pylist()
        for row, text, (ends, runs_of), spans in zip(part.column("row").to_pylist(), texts, run_places(texts, min_words), part.column("spans").to_pylist()):
            yield row, text, _removed(ends, runs_of, spans)


def _by_document(docs, min_words, id_col, text_col, how) -> tuple[DataFrame, str]:
    """``docs`` with the spans of each row to be removed, in a column whose name is returned."""
    at, key, spans = unused(docs, "span_doc", "span_text", "spans")
    late = repeated_runs(docs, min_words, id_col, text_col)
    lists = late.groupBy(F.col("doc").alias(at), F.col("text_key").alias(key)).agg(F.collect_set(F.struct("run", "first_doc_id")).alias(spans))
    doc, text_key = _key(id_col, text_col)
    return docs.join(lists, (doc == F.col(at)) & (text_key == F.col(key)), how).drop(at, key), spans


def removed_spans(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end, first_doc_ids, removed) of every passage that dedup removes.

    ``begin`` and ``end`` count characters of the text; ``first_doc_ids``: documents that keep the
    passage's sentences. Texts without repeats, null and empty ones give no row; identical
    rows give identical rows. Further columns aren't read.
    """
    joined, name = _by_document(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), min_words, "doc_id", "text", "inner")

    def cut(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[row], begin, end, origins, text[begin:end]) for row, text, found in _places(batch, "text", name, min_words) for begin, end, origins in found]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "begin", "end", "first_doc_ids", "removed"])

    return joined.select("doc_id", "text", name).mapInArrow(cut, "doc_id long, begin long, end long, first_doc_ids array<long>, removed string")


def dedup(docs: DataFrame, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without sentences of repeated runs.

    A document of which nothing is left has an empty text; null stays null, and rows
    without repeats stay as they are.
    """
    joined, name = _by_document(docs, min_words, id_col, text_col, "left")

    def cut(batches):
        for batch in batches:
            column = batch.column(text_col).to_pylist()
            for row, text, found in _places(batch, text_col, name, min_words):
                at, kept = 0, []
                for begin, end, _ in found:
                    kept.append(text[at:begin])
                    at = end
                column[row] = "".join(kept) + text[at:]
            names = [n for n in batch.schema.names if n != name]
            arrays = [pa.array(column, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], name).mapInArrow(cut, docs.schema)
