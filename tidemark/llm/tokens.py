"""Ids of the public byte-level BPE vocabulary, in Python tasks."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Id that ends a document in token files; no ordinary text yields it, only its marker read as special.
END_OF_TEXT = 50256
MARKER = "<|endoftext|>"

#: White space as the vocabulary's pattern knows it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WHITE}][{_WHITE}]")
#: Runs of white space from this length on are split by hand: the pattern engine recurses over them.
LONG_RUN = 4096
_LONG = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Function text -> list of ids, equal to those of ``byte_bpe_50k.json`` with special tokens as text.

    The usual splitting pattern looks ahead behind runs of white space. A text without such runs
    splits the same way without the look-ahead, which is faster. Of a run, all but the last character
    is one piece, or all of it at the end of the text; very long runs are encoded as that piece
    directly, so their length does not matter.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY)) as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, file)}
    pattern = public_tokenizers.PATTERN
    plain = pattern.replace(r"\s+(?!\S)|", "")
    make = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
    whole, quick = make("whole", pat_str=pattern), make("quick", pat_str=plain)

    def encode(text: str) -> list[int]:
        if not _RUN.search(text):
            return quick.encode_ordinary(text)
        ids, start = [], 0
        for run in _LONG.finditer(text):
            cut = run.end() - (run.end() < len(text))
            ids += whole.encode_ordinary(text[start : run.start()])
            ids += whole._encode_single_piece(text[run.start() : cut])
            start = cut
        return ids + whole.encode_ordinary(text[start:])

    return encode


def encode_array(text: str | None, path: str | None = None, special: bool = False) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit numbers; null has none.

    With ``special`` the end-of-text marker in a text is its own id, as the tokenizer file has it;
    otherwise it is text like any other, and no id in the result is ``END_OF_TEXT``.
    """
    if not text:
        return np.array([], dtype="<u4")
    encode = encoder(path)
    if not special or MARKER not in text:
        return np.array(encode(text), dtype="<u4")
    ids: list[int] = []
    for k, part in enumerate(text.split(MARKER)):
        ids += [END_OF_TEXT] * (k > 0) + encode(part)
    return np.array(ids, dtype="<u4")
