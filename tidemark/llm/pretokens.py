"""Pre-tokens of byte-level BPE, found in whole batches of texts with numpy.

The rule is the public pattern of that tokenizer family: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers,
or of other characters, each with one space before it; white space, less its last character if something follows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Letters after an apostrophe that make a contraction.
ONE, TWO = "stmd", ("re", "ve", "ll")


@cache
def _classes() -> np.ndarray:
    """The class of each code point by the Unicode tables of the tokenizer library itself, which need not be Python's."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of the texts, and how many each text has."""
    words, places, counts = coded([t.encode("utf-8", "surrogatepass") for t in texts])
    return [words[k].decode("utf-8", "surrogatepass") for k in places.tolist()], counts


def _kinds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of UTF-8 text, and the class of the character that each is of."""
    code, classes = np.frombuffer(raw, np.uint8), _classes()
    kind = classes[:256][code]
    if not raw.isascii():
        lead = np.flatnonzero(code >= 0xC0)
        first = code[lead]
        for more, low, high, bits in ((1, 0xC0, 0xE0, 0x1F), (2, 0xE0, 0xF0, 0x0F), (3, 0xF0, 0x100, 0x07)):
            at = lead[(first >= low) & (first < high)]
            point = (code[at] & bits).astype(np.int32)
            for k in range(1, more + 1):
                point = point << 6 | (code[at + k] & 0x3F)
            own = classes[point]
            for k in range(more + 1):
                kind[at + k] = own
    return code, kind


def coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts in UTF-8, the place of each text's pre-tokens among them, and how many each text has."""
    if not texts:
        return [], np.zeros(0, np.int32), np.zeros(0, np.int64)
    raw = b"\n".join(texts) + b"\n"
    code, kind = _kinds(raw)
    edge = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[edge] = EDGE
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[edge] = True
    start[edge[:-1] + 1] = True
    # White space before something else leaves its last character: a plain space joins what follows, others stand alone.
    after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] != EDGE)) + 1
    last = after - 1
    for _ in range(0 if raw.isascii() else 3):
        last = last - (code[last] & 0xC0 == 0x80)
    start[last] = True
    start[after[code[last] == 32]] = False
    quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
    if quote.size:
        short = np.isin(code[quote + 1], [ord(c) for c in ONE])
        second = np.minimum(quote + 2, len(code) - 1)
        long = ~short & np.isin(code[quote + 1].astype(np.int64) << 8 | code[second], [ord(a) << 8 | ord(b) for a, b in TWO])
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            rest = hit[kind[np.minimum(hit + size, len(kind) - 1)] == LETTER]
            start[rest + size] = True
    at = np.flatnonzero(start)
    real = kind[at] != EDGE
    # All pieces, the edges between texts too, as an Arrow array over the text itself: only distinct ones become Python objects.
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(code)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    return pieces.dictionary.to_pylist(), pieces.indices.to_numpy()[real], np.diff(np.searchsorted(at[real], edge), prepend=0)
