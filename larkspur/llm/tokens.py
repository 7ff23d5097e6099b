"""Token ids of whole texts by a public tokenizer, chunk by chunk with a bounded cache.

Text is cut only between a character that surely is no white space and a following space or line feed,
and between an ASCII letter and a following ASCII sign.
No pre-token of the supported vocabularies reaches over such places, so the pieces' ids, in a row, are
the text's ids. Each distinct piece of a batch is encoded once.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Distinct pieces of one generation; a Python worker remembers the current and the last one.
CACHE_PIECES = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = True  # not |, which ends <|...|> strings


def tokenizer_json(path: str) -> str:
    """The vocabulary file's content, of a few MB, which travels to the executors with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _load(json_text: str):
    import hashlib

    from tokenizers import Tokenizer

    from larkspur.llm.runtime import worker_cache

    key = ("tokenizer", hashlib.md5(json_text.encode()).hexdigest())
    store = worker_cache()
    if key not in store:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store[key] = [Tokenizer.from_str(json_text), {}, {}]
    return store[key]


def _cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets of the pieces in buf: at each text's start and before a space or line feed that follows a visible ASCII character or a two-byte one from U+00C0 on, none of which is white space, and before an ASCII sign that follows an ASCII letter."""
    if not len(buf):
        return starts
    space = (buf == 0x20) | (buf == 0x0A)
    prev = np.empty_like(buf)
    prev[0] = 0x20
    prev[1:] = buf[:-1]
    cut = space & (prev > 0x20) & (prev < 0x7F)
    two = np.zeros(len(buf), bool)
    two[2:] = (buf[:-2] >= 0xC3) & (buf[:-2] <= 0xDF)
    cut |= space & two
    cut |= _SIGN[buf] & _LETTER[prev]
    cut[starts[starts < len(buf)]] = True
    return np.flatnonzero(cut)


def _ids_of(words: list[bytes], state: list) -> list[bytes]:
    """Each piece's ids as bytes of uint32."""
    tok, known, old = state
    if len(known) > CACHE_PIECES:
        state[1:] = known, old = {}, known
    missing = []
    for w in words:
        if w not in known:
            if w in old:
                known[w] = old[w]
            else:
                missing.append(w)
    for i in range(0, len(missing), 20_000):
        part = missing[i : i + 20_000]
        for w, e in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
    return [known[w] for w in words]


def encode(texts, json_text: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row as uint32, and each text's number of ids. texts: an Arrow string array; null is empty. end_id is appended to each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    state = _load(json_text)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        n = np.full(len(size), int(end_id is not None), np.int64)
        return np.full(int(n.sum()), end_id or 0, np.uint32), n
    first = texts.buffers()[1]
    base = int(np.frombuffer(first, np.int64, len(texts) + 1 + texts.offset)[texts.offset])
    buf = np.frombuffer(texts.buffers()[2], np.uint8, total, base)
    at = _cuts(buf, starts[size > 0])
    offs = np.append(at, total).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(buf)]).dictionary_encode()
    words = pieces.dictionary.to_pylist()
    raw = _ids_of(words, state)
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) >> 2
    table = np.frombuffer(b"".join(raw), np.uint32)
    first_of = np.cumsum(lens) - lens
    idx = pieces.indices.to_numpy(zero_copy_only=False)
    n_piece = lens[idx]
    # ids of each text
    n_text = np.zeros(len(size), np.int64)
    n_text[size > 0] = np.add.reduceat(n_piece, np.searchsorted(at, starts[size > 0]))
    out_at = np.cumsum(n_piece) - n_piece
    src = np.repeat((first_of[idx] - out_at).astype(np.int32), n_piece)
    src += np.arange(len(src), dtype=np.int32)
    ids = table[src]
    if end_id is None:
        return ids, n_text
    full = np.empty(len(ids) + len(size), np.uint32)
    last = np.cumsum(n_text + 1) - 1
    keep = np.ones(len(full), bool)
    keep[last] = False
    full[keep] = ids
    full[last] = end_id
    return full, n_text + 1
