from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from holdfast.llm import encoding
from tokenizers import Tokenizer


@pytest.mark.parametrize("name, lowered", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_only_other_than_ascii_pieces_are_looked_at_by_character(name, lowered, monkeypatch):
    looked_at, is_latin = [], encoding.is_latin
    monkeypatch.setattr(encoding, "is_latin", lambda piece: looked_at.append(piece) or is_latin(piece))
    path = public_tokenizers.path(name)
    texts = ["The WORD, the word: 12 a1b2 don't", "Été ñandú ÉTÉ.", "Ωmega ΣΑΣ x² ½ İx", None, "", "a  b\tc", "naïve\nX I'LL 'S", "K K"]
    ids, counts = encoding.encode(encoding.LibraryEncoder(path, lowered), pa.array(texts, pa.string()))
    library = Tokenizer.from_file(path)
    found = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not any(piece.isascii() for piece in looked_at)
    assert bool(looked_at) == lowered
