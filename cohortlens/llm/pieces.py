"""SentencePiece encoding and decoding as a relational lattice.

Text is written as the vocabulary writes it (a leading mark, marks for spaces) and cut into words, and these into parts,
at places that no piece spans, so that each part can be encoded apart from the others. Every distinct part's substrings
of bounded length are exploded and joined to the piece table; its edges are grouped by part, and Viterbi is folded over
them by a higher-order aggregate. What was found goes back to the documents by blocks.

A part of more than CHUNK characters is cut into chunks of that size. Pieces may span their borders, so a chunk also has
the characters that such a piece can reach, and is folded from every position where a way can enter it. The cheapest
chain of entries and exits over a part's chunks is then found where its document is put together. So time and space grow
in proportion to a part's length, and equal chunks are worked on once.

The public vocabulary has ranks and no probabilities, so a piece of rank r gets a probability in proportion to
1 / (r + 1); the encoding is the likeliest segmentation (a unigram model's, not the merges of a BPE model). A character
that no piece holds weighs 10 less than the last piece and becomes the pieces of its UTF-8 bytes. Decoding turns ids back
into the text, but for literal marks (U+2581), which the vocabulary takes for spaces.

Edge cases: null and empty texts have no pieces. Of equally good ways within a chunk, the one whose last piece begins
first wins. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .lattice import DEFAULT_VOCABULARY, MARK, Vocabulary, read_vocabulary

#: A piece of text after a line break has no mark before it; PLAIN tells it from one that has.
PLAIN = "\0"
_MARK_BYTES = MARK.encode()
_RUN = re.compile(" +[^ ]*|[^ ]+")
#: Text whose distinct words make one task of the lattice: some 10,000 words, whose edges are sorted in memory.
PART_CHARS = 1_500_000
#: Words that are cut into parts at a time, and parts whose ids are joined to texts at a time (or one text's, if more).
REFINED, JOINED = 1 << 16, 1 << 20
#: Characters of a chunk, to which the longest piece's reach is added.
CHUNK = 256
#: First characters of a chunk that goes on, of a part's last chunk, and of other parts that begin with one of these.
GOES_ON, LAST, OTHER = "\x01", "\x02", "\x03"


def _runs(text: str) -> Iterator[str]:
    for i, line in enumerate(text.split("\n")):
        if i:
            yield "\n"
        for run in _RUN.findall(line if i else " " + line):
            word = run[1:].replace(" ", MARK)
            yield PLAIN + run if run[0] != " " else PLAIN + MARK + word if word[:1] == PLAIN else word


def split(texts: pa.Array) -> pa.ListArray:
    """Words that stand after one space or the start, without that mark; line breaks; and the text right after these."""
    lines = pc.replace_substring(texts, "\n", f" \n {PLAIN}")
    odd = pc.or_(pc.or_(pc.match_substring(lines, "  "), pc.starts_with(lines, " ")), pc.match_substring(texts, PLAIN))
    plain = pc.split_pattern(pc.if_else(pc.or_(odd, pc.equal(texts, "")), pa.scalar(None, texts.type), lines), " ")
    if not pc.any(odd).as_py():
        return plain
    own = pa.array([list(_runs(t)) for t in texts.filter(odd).to_pylist()], plain.type)
    at = np.arange(len(texts))
    at[odd.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(own))
    return pa.concat_arrays([plain, own]).take(pa.array(at))


def _reach(vocab: Vocabulary) -> int:
    return max(map(len, vocab.pieces)) - 1


def _chunked(part: str, reach: int) -> list[str]:
    """A part as it travels: marked, and in chunks if it is long."""
    if len(part) <= CHUNK + reach:
        return [OTHER + part if part[:1] in (GOES_ON, LAST, OTHER) else part]
    at = range(0, len(part), CHUNK)
    return [(GOES_ON if i + CHUNK < len(part) else LAST) + part[i : i + CHUNK + reach] for i in at]


def refiner(vocab: Vocabulary) -> blocks.Refine:
    """Words are cut between characters that no piece holds side by side: no segmentation is lost, and there are fewer
    and shorter distinct parts."""
    if any("\n" in p or MARK in p.strip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in vocab.pieces):
        raise ValueError("this vocabulary has pieces that span words")
    pairs, reach = np.array(sorted({ord(p[i]) << 21 | ord(p[i + 1]) for p in vocab.pieces for i in range(len(p) - 1)}), np.int64), _reach(vocab)

    def cut(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        bare = pc.or_(pc.equal(words, "\n"), pc.starts_with(words, PLAIN))
        texts = pc.if_else(bare, pc.replace_substring(words, PLAIN, "", max_replacements=1), pc.binary_join_element_wise(MARK, words, ""))
        length = pc.utf8_length(texts).to_numpy().astype(np.int64)
        joined, _ = blocks.raw(texts)
        codes = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        pair = np.concatenate([[0], codes[:-1] << 21 | codes[1:]])[: len(codes)]
        found = np.searchsorted(pairs, pair)
        found[found == len(pairs)] = 0
        begins = pairs[found] != pair
        begins[(np.cumsum(length) - length)[length > 0]] = True
        at = np.flatnonzero(begins)
        byte = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        parts = pa.StringArray.from_buffers(len(at), pa.py_buffer(byte[np.append(at, len(codes))].astype(np.int32)), pa.py_buffer(joined))
        return parts.dictionary_encode(), np.bincount(np.repeat(np.arange(len(texts)), length)[at], minlength=len(texts))

    def refine(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded, n = zip(*[cut(words[i : i + REFINED]) for i in range(0, max(1, len(words)), REFINED)], strict=True)
        distinct, numbers = blocks.unified(list(coded))
        number, first = np.concatenate(numbers), np.concatenate([[0], np.cumsum(np.concatenate(n))])
        odd = pc.or_(pc.greater(pc.utf8_length(distinct), CHUNK + reach), pc.match_substring_regex(distinct, f"^[{GOES_ON}{LAST}{OTHER}]"))
        if pc.any(odd).as_py():
            split_up = [_chunked(p, reach) for p in distinct.to_pylist()]
            size = np.array([len(c) for c in split_up])[number]
            coded = pa.array([c for i in number.tolist() for c in split_up[i]], pa.string()).dictionary_encode()
            distinct, first = coded.dictionary, np.concatenate([[0], np.cumsum(size)])[first]
            number = coded.indices.to_numpy()
        return distinct, number, first

    return refine


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text.replace(_MARK_BYTES, b" "))


#: The fold from position `entry`: the positions that a way reaches, with its weight and the last piece's begin and id.
#: Only back references are kept. Positions come one after another up to the chunk's end; few lie beyond it.
_FOLD = """
transform(if(kind = 0, array(0), sequence(0, {reach})), entry -> aggregate(
  if(entry = 0, edges, filter(edges, x -> x.from >= entry)),
  named_struct('done', array(named_struct('at', entry, 'w', 0D, 'from', 0, 'id', 0)), 'at', entry, 'w', cast(null as double), 'from', 0, 'id', 0),
  (a, e) -> transform(array(if(e.to > a.at and a.at > entry, array_append(a.done, named_struct('at', a.at, 'w', a.w, 'from', a.from, 'id', a.id)), a.done)),
      d -> if(e.to = a.at and a.w >= d[e.from - entry].w + e.w,
        named_struct('done', d, 'at', a.at, 'w', a.w, 'from', a.from, 'id', a.id),
        named_struct('done', d, 'at', e.to, 'w', d[e.from - entry].w + e.w, 'from', e.from, 'id', e.id)))[0],
  a -> if(a.at > entry, array_append(a.done, named_struct('at', a.at, 'w', a.w, 'from', a.from, 'id', a.id)), a.done)))
"""


def encode_words(words: DataFrame, vocab: Vocabulary, parts: int) -> DataFrame:
    """(h, kind, places, ats, begins, ids, weights) of (word, place): for each entry (one, but for chunks) the positions
    that the best ways reach, their last pieces' begins and ids, and their weights. An unknown character c is the id -1 - c.

    The piece table is as large as the vocabulary, so it is broadcast. Words are dealt by their hash h and told apart by
    their least place, so that no word is carried along with its edges; nothing else is shuffled.
    """
    spark = words.sparkSession
    weight = vocab.prior[: len(vocab.pieces)]
    table = spark.createDataFrame(pa.table({"piece": vocab.pieces, "id": pa.array(vocab.ids), "w": weight}))
    reach, unknown = _reach(vocab), float(weight.min()) - 10
    dealt = words.repartition(parts, F.xxhash64("word"))
    once = dealt.groupBy(F.xxhash64("word").alias("h"), "word").agg(F.min("place").alias("key"), F.collect_list("place").alias("places"))
    mark = F.ascii("word")
    once = once.withColumn("kind", F.when((mark >= 1) & (mark <= 2), mark).otherwise(0)).withColumn("word", F.when((mark >= 1) & (mark <= 3), F.expr("substring(word, 2)")).otherwise(F.col("word")))
    # one row more, of position -1, has the places
    ends = once.select("h", "key", "kind", "word", "places", F.explode(F.sequence(F.lit(-1), F.length("word") - 1)).alias("from"))
    ends = ends.filter((F.col("kind") != 1) | (F.col("from") < CHUNK))
    size = F.when(F.col("from") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.least(F.lit(reach + 1), F.length("word") - F.col("from"))))
    subs = ends.select("h", "key", "kind", "word", F.when(F.col("from") < 0, F.col("places")).alias("places"), "from", F.explode(size).alias("n"))
    subs = subs.withColumn("piece", F.substring("word", F.col("from") + 1, F.col("n"))).drop("word")
    found = subs.join(F.broadcast(table), "piece", "left").filter("id is not null or n < 2")
    edge = F.struct((F.col("from") + F.col("n")).alias("to"), "from", F.coalesce("w", F.lit(unknown)).alias("w"), F.coalesce("id", -1 - F.ascii("piece")).alias("id"))
    grouped = found.groupBy("h", "key", "kind").agg(F.first("places", ignorenulls=True).alias("places"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, edge))).alias("edges"))
    best = grouped.select("h", "kind", "places", F.expr(_FOLD.format(reach=reach)).alias("best"))
    each = lambda f: F.expr(f"transform(best, b -> transform(b, x -> x.{f}))")
    return best.select("h", "kind", "places", each("at").alias("ats"), each("from").alias("begins"), each("id").alias("ids"), F.when(F.col("kind") > 0, each("w")).alias("weights"))


def _way(at: list[int], begins: list[int], ids: list[int], leave: int, byte_ids: np.ndarray) -> list[int]:
    """The ids on the best way to position `leave`, followed back from there."""
    out, where = [], {a: i for i, a in enumerate(at)}
    while leave > at[0]:
        i = where[leave]
        out += [ids[i]] if ids[i] >= 0 else byte_ids[list(chr(-1 - ids[i]).encode("utf-8", "surrogatepass"))][::-1].tolist()
        leave = begins[i]
    return out[::-1]


def _ways(begins: pa.ListArray, ids: pa.ListArray, byte_ids: np.ndarray) -> pa.ListArray:
    """The ids on each word's best way, all words at a time: one step back for every word that is not at its start."""
    first = begins.offsets.to_numpy().astype(np.int64)
    b, i = begins.flatten().to_numpy(), ids.flatten().to_numpy()
    first, at = first[:-1] - first[0], np.diff(first) - 1
    rows, steps, go, depth = [], [], np.flatnonzero(at > 0), 0
    found = []
    while len(go):
        where = first[go] + at[go]
        rows.append(go)
        found.append(i[where])
        steps.append(np.full(len(go), depth))
        at[go] = b[where]
        go, depth = go[at[go] > 0], depth + 1
    if not rows:
        return pa.array([[]] * len(begins), pa.list_(pa.int32()))
    row, piece = np.concatenate(rows), np.concatenate(found).astype(np.int64)
    order = np.lexsort((-np.concatenate(steps), row))
    row, piece = row[order], piece[order]
    odd = np.flatnonzero(piece < 0)
    if len(odd):
        spelt = [byte_ids[list(chr(-1 - p).encode("utf-8", "surrogatepass"))] for p in piece[odd].tolist()]
        times = np.ones(len(piece), np.int64)
        times[odd] = [len(s) for s in spelt]
        piece, row, starts = np.repeat(piece, times), np.repeat(row, times), np.cumsum(times) - times
        for a, s in zip(starts[odd].tolist(), spelt, strict=True):
            piece[a : a + len(s)] = s
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(begins)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(piece, pa.int32()))


def _answers(batches: Iterator[pa.RecordBatch], byte_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ways of whole words as ids; chunks (None there) with all that is known of them, packed."""
    names = ("ats", "begins", "ids", "weights")
    for batch in batches:
        kind, c = batch.column("kind").to_numpy(), {k: batch.column(k) for k in names}
        chunk = np.flatnonzero(kind)
        # a word has one entry, a chunk several: a word's first list is its only one
        inner = {k: c[k].flatten() for k in ("begins", "ids")}
        lists = c["begins"].offsets.to_numpy()[:-1] - c["begins"].offsets.to_numpy()[0]
        ids = _ways(inner["begins"].take(pa.array(lists)), inner["ids"].take(pa.array(lists)), byte_ids)
        packed = [None] * batch.num_rows
        for i in chunk.tolist():
            packed[i] = blocks.pack({k: c[k][i].values for k in names} | {"last": pa.array([kind[i] == 2] * len(c["ats"][i].values))})
        yield blocks.answers(batch.column("places"), batch.column("h").to_numpy(), {"ids": ids, "chunk": pa.array(packed, pa.binary())})


class _Chunk:
    def __init__(self, body: bytes):
        b = blocks.unpack(body)
        self.at, self.begins, self.ids, self.weights = (b.column(k).to_pylist() for k in ("ats", "begins", "ids", "weights"))
        self.last = b.column("last")[0].as_py()
        # a chunk that goes on is left at CHUNK or a little after it, the last one at its end
        self.exits = [{a - CHUNK: w for a, w in zip(at, ws, strict=True) if a >= CHUNK} for at, ws in zip(self.at, self.weights, strict=True)]


def _chain(chunks: list[_Chunk], byte_ids: np.ndarray) -> list[int]:
    """The ids of a part: the cheapest chain of its chunks' entries and exits, followed back."""
    cost, back = {0: 0.0}, []
    for c in chunks[:-1]:
        new: dict[int, tuple[float, int]] = {}
        for entry, w in cost.items():
            for leave, v in c.exits[entry].items():
                if leave not in new or w + v > new[leave][0]:
                    new[leave] = (w + v, entry)
        back.append({k: e for k, (_, e) in new.items()})
        cost = {k: w for k, (w, _) in new.items()}
    end = max(chunks[-1].at[0])
    entry = max((w + chunks[-1].weights[e][chunks[-1].at[e].index(end)], -e) for e, w in cost.items() if e <= end)[1]
    out, entry, leave = [], -entry, end
    for c, came in zip(reversed(chunks), [*reversed(back), None], strict=True):
        out.append(_way(c.at[entry], c.begins[entry], c.ids[entry], leave, byte_ids))
        if came is not None:
            leave, entry = entry + CHUNK, came[entry]
    return [i for ids in reversed(out) for i in ids]


def _joined(ids: pa.ListArray, packed: pa.Array, tokens: np.ndarray, at: np.ndarray, byte_ids: np.ndarray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Runs of chunks become tokens of their own, each with the ids of its part."""
    chunks = {i: _Chunk(packed[i].as_py()) for i in np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False)).tolist()}
    where = np.flatnonzero(np.isin(tokens, list(chunks)))
    made: dict[tuple[int, ...], int] = {}
    tokens, keep, run = tokens.astype(np.int64), np.ones(len(tokens), bool), []
    for p in where.tolist():
        run.append(int(tokens[p]))
        keep[p] = chunks[run[-1]].last
        if keep[p]:
            tokens[p] = len(ids) + made.setdefault(tuple(run), len(made))
            run = []
    more = pa.array([_chain([chunks[i] for i in r], byte_ids) for r in made], pa.list_(pa.int32()))
    return pa.concat_arrays([ids, more]), tokens[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _spell(vocab: Vocabulary) -> list[bytes]:
    out = [b""] * (1 + max(int(vocab.ids.max()), int(vocab.byte_ids.max())))
    for i, p in zip(vocab.ids.tolist(), vocab.pieces, strict=True):
        out[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(vocab.byte_ids.tolist()):
        out[i] = bytes([b])
    return out


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids, n_pieces, round_trip): the pieces' ids of every text, and whether they decode to that text."""
    vocab = read_vocabulary(vocabulary)
    refine, byte_ids = refiner(vocab), vocab.byte_ids
    spell = docs.sparkSession.sparkContext.broadcast(_spell(vocab))
    rows = blocks.prepared(docs, id_col, text_col, F.lit(False))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    words = blocks.word_rows(rows, split, "string", refine).select("word", "place")
    found = encode_words(words, vocab, max(1, math.ceil(chars / PART_CHARS))).mapInArrow(lambda it: _answers(it, byte_ids), "block long, answer binary")

    def combine(table: pa.Table | None, body: pa.RecordBatch, tokens: np.ndarray, at: np.ndarray) -> pa.Table:
        ids = table.column("ids").combine_chunks() if table else pa.array([], pa.list_(pa.int32()))
        if table and table.column("chunk").null_count < table.num_rows:
            ids, tokens, at = _joined(ids, table.column("chunk").combine_chunks(), tokens, at, byte_ids)
        sizes, made, same = np.diff(ids.offsets.to_numpy()), [], []
        for a, b in blocks.stretches(at, JOINED):
            now = tokens[at[a] : at[b]]
            flat = ids.take(pa.array(now)).flatten()
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes[now])])[at[a : b + 1] - at[a]], pa.int32())
            made.append(pa.ListArray.from_arrays(ends, flat))
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(spell.value, pa.binary()).take(flat)), b"")
            same += [xxhash.xxh64_intdigest(t[1:]) == d for t, d in zip(texts.to_pylist(), body.column("digest")[a:b].to_pylist(), strict=True)]
        found = pa.chunked_array(made, pa.list_(pa.int32()))
        return pa.table({"id": body.column("id"), "ids": found, "n_pieces": pc.list_value_length(found).cast(pa.int64()), "round_trip": pa.array(same, pa.bool_())})

    schema = f"id {dict(docs.dtypes)[id_col]}, ids array<int>, n_pieces long, round_trip boolean"
    return blocks.join_back(found, blocks.doc_rows(rows, split, digest, refine), combine, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, ids_col: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`encoded` with a column `decoded`: the text of a list of ids (null if that is null)."""
    spell = encoded.sparkSession.sparkContext.broadcast(_spell(read_vocabulary(vocabulary)))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda row: None if row is None else b"".join(map(spell.value.__getitem__, row)).decode("utf-8", "replace")[1:])

    return encoded.withColumn("decoded", text(ids_col))
