"""Encoding and decoding with a SentencePiece model through a table of distinct chunks.

Where no piece holds a white-space marker behind another character, merges never cross the place before a marker, so a text
splits there into chunks that are segmented independently. Every distinct chunk of the corpus is segmented once; documents
then get their ids by joining the chunks back by position.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onledger.llm import blocks as B
from onledger.llm import text as T

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = SCHEMA + ", ids array<int>, decoded string"
_LOADED: dict = {}


def model(blob: bytes):
    """The processor of a model, once per worker."""
    import sentencepiece

    key = hashlib.sha256(blob).digest()
    if key not in _LOADED:
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        _LOADED[key] = sp
    return _LOADED[key]


def read_model(path: str) -> bytes:
    """The model's bytes; refuses a model whose pieces cross markers, for which chunks would not be independent."""
    with open(path, "rb") as f:
        blob = f.read()
    sp = model(blob)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers")
    if [sp.id_to_piece(i) for i in sp.encode(f"a  {MARK}b ")] != [MARK + "a", MARK * 2, MARK + "b", MARK]:
        raise ValueError("this model normalises white space; chunks need the identity normaliser with a leading marker")
    return blob


def chunks(raw: str) -> list[str]:
    """The marked text's chunks, each without its first marker (which the model puts back)."""
    if not raw:
        return []
    if MARK not in raw and "  " not in raw and raw[0] != " " and raw[-1] != " ":
        return raw.split(" ")
    return [c[1:] for c in CHUNK.findall(MARK + raw.replace(" ", MARK))]


def distinct(rows) -> tuple[list[str], np.ndarray]:
    """The distinct chunks of a block with their hashes, ordered by hash."""
    seen: set[str] = set()
    for _, raw, *_ in rows:
        if raw:
            seen.update(chunks(raw.decode("utf-8", "replace")))
    words = list(seen)
    coded = [w.encode() for w in words]
    end = np.cumsum([len(c) for c in coded], dtype=np.int64) if coded else np.zeros(0, np.int64)
    start = end - np.array([len(c) for c in coded], np.int64)
    buffer = np.frombuffer(b"".join(coded), np.uint8)
    keys = T.Prefix(T.CODES[0][buffer]).spans(start, end)
    order = np.lexsort((np.array(words, object), keys)) if len(np.unique(keys)) < len(keys) else np.argsort(keys)
    return [words[i] for i in order], keys[order]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Ids of every text and the text decoded from them.

    Result: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``full`` the ids and the decoded text themselves. One row
    for each input row, repeated rows included. A null text counts as empty: no ids, empty decoded text. Other columns of
    the input are ignored. The model file is read on the driver and travels with the tasks (its size is that of a file, not
    of the data).
    """
    blob = read_model(model_path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(blob)
    packed = B.blocks(docs, id_col, text_col)
    buckets = B.buckets_for(packed, docs)

    def pieces(rows):
        words, keys = distinct(rows)
        for bucket, lo, hi in B.slices(keys, buckets):
            coded = [w.encode() for w in words[lo:hi]]
            yield bucket, B.pack_arrays(np.array([len(c) for c in coded], np.int32), np.frombuffer(b"".join(coded), np.uint8))

    def reply(_, came):
        sp = model(shared.value)
        lone = sp.piece_to_id(MARK)
        asked = []
        for block, data in came:
            asked.append((block, [w.decode() for w in B.split(*B.unpack_arrays(data))]))
        table = dict.fromkeys(itertools.chain.from_iterable(w for _, w in asked))
        unique = list(table)
        table = {w: np.array(ids if w else [lone], np.int32) for w, ids in zip(unique, sp.encode(unique, num_threads=1))}
        for block, words in asked:
            ids = [table[w] for w in words]
            yield block, B.pack_arrays(np.array([len(i) for i in ids], np.int32), np.concatenate(ids).astype(np.uint16 if sp.get_piece_size() <= 65536 else np.int32))

    def result(_, rows, got):
        sp = model(shared.value)
        words, keys = distinct(rows)
        table = {}
        for bucket, lo, hi in B.slices(keys, buckets):
            lengths, ids = B.unpack_arrays(got[bucket])
            ids, at = ids.tolist(), 0
            for w, n in zip(words[lo:hi], lengths.tolist()):
                own = ids[at:at + n]
                table[w] = (own, ",".join(map(str, own)))
                at += n
        out = {name: [] for name in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if full else ()))}
        for doc_id, raw, _ in rows:
            parts = [table[c] for c in chunks((raw or b"").decode("utf-8", "replace"))]
            ids = list(itertools.chain.from_iterable(p[0] for p in parts))
            decoded = sp.decode(ids) if ids else ""
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(p[1] for p in parts).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if full:
                out["ids"].append(ids)
                out["decoded"].append(decoded)
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
                 "ids": pa.list_(pa.int32()), "decoded": pa.string()}
        return {k: pa.array(v, kinds[k]) for k, v in out.items()}

    return B.finish(packed, B.answer(B.ask(packed, pieces), reply), result, FULL if full else SCHEMA)
