"""Whole-text BPE encoding with the ``tokenizers`` library, memoised by word."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from codeloom.llm.common import quiet_tokenizers

#: White space beyond ASCII (fixed values of Unicode, and some that other libraries count): such a text is encoded whole.
WIDE_SPACE = "\x85\xa0 ᠎    　﻿" + "".join(map(chr, range(0x2000, 0x200C)))
#: Marks the cuts of a batch.
CUT = "\x01"
#: Vocabularies that drop white space.
SPACELESS = {"word_bpe_49k.json"}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Both public vocabularies end a pre-token where a run of white space begins, and between a letter or digit and a full
    stop or comma, so a text may be cut there and the pieces encoded by themselves. A batch is cut and its distinct pieces found with
    Arrow; their ids come from a memo of the worker, and the batch's ids are gathered with numpy. New pieces go to the
    library joined by a special token, which it splits off before anything else and whose id marks where each ends. Texts
    with a cut inside a run of white space or of other signs, with a capital that becomes a letter and a sign, with other white space than ASCII's, or with the spelling of
    a special token, are encoded in one piece. The memo is bounded: beyond ``limit`` pieces it starts anew, and pieces of more than
    ``longest`` characters are not kept. Null is encoded as the empty text.
    """

    def __init__(self, tokenizer: str, limit: int = 700_000, longest: int = 48):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(specials.items()))
        self.whole = "|".join([*(re.escape(s) for s in specials), f"[{WIDE_SPACE}{CUT}İ]", r"[\t-\r ][ \n]", r"[^\pL\pN][.,]"])
        self.spaces = tokenizer not in SPACELESS
        self.memo: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        joined = [self.mark.join(pieces[at : at + 256]) + self.mark for at in range(0, len(pieces), 256)]
        out: list[bytes] = []
        for ids in self._ids(joined):
            raw, begin = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self.mark_id) * 4).tolist():
                out.append(raw[begin:end])
                begin = end + 4
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of a batch's distinct pieces."""
        memo = self.memo
        got = list(map(memo.get, pieces))
        new = [k for k, b in enumerate(got) if b is None]
        if len(memo) + len(new) > self.limit:
            memo.clear()
        for k, b in zip(new, self._learn([pieces[k] for k in new]), strict=True):
            got[k] = b
            if len(pieces[k]) <= self.longest:
                memo[pieces[k]] = b
        return got

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, and where each text's end."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(whole), "", texts)
        for c in " \n.,":
            cut = pc.replace_substring(cut, c, CUT + c if self.spaces or c in ".," else CUT)
        cut = pc.split_pattern(cut, CUT)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        raw = self._pieces(words)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat = np.frombuffer(b"".join(raw), dtype="<u4")
        n = size[codes]
        ends = np.cumsum(n)
        place = np.repeat(((np.cumsum(size) - size)[codes] - (ends - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)  # a batch is some megabytes of text
        ids = flat[place]
        del place
        bounds = np.concatenate(([0], ends))[offsets[1:]] if len(offsets) > 1 else np.zeros(0, np.int64)
        if whole.any():
            at = np.flatnonzero(whole)
            parts = np.split(ids, bounds[:-1])
            for k, own in zip(at.tolist(), self._ids([texts[k].as_py() for k in at.tolist()]), strict=True):
                parts[k] = own
            ids, bounds = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, bounds

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def encode_many(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text and then ``end_id``."""
        ids, bounds = self.encode_batch(texts)
        raw, end = ids.tobytes(), np.array([end_id], dtype="<u4").tobytes()
        at = [0, *(4 * bounds).tolist()]
        return [raw[a:b] + end for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer: str) -> WordEncoder:
    """One encoder for each Python worker, kept over its tasks."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]
