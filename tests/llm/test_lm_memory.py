"""Tokens of a slice of texts take little memory."""

import tracemalloc

import numpy as np
import xxhash

from auditlake.llm.lm_scoring import START, tokens


def test_tokens_in_little_memory():
    texts = [b"The w%d of  a\tbook " % i * 50 for i in range(5000)] + [b"", b" \n"]
    tracemalloc.start()
    codes, before, starts = tokens(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * codes.nbytes  # a list of all words took ten times as much
    words = [w for t in texts for w in (*t.lower().split(), b" end")]
    assert codes.tolist() == [xxhash.xxh64_intdigest(w, seed=7) for w in words]
    assert starts.tolist() == np.cumsum([0, *(len(t.split()) + 1 for t in texts)])[:-1].tolist()
    assert (before[starts] == START).all() and (before[1:][np.diff(np.searchsorted(starts, np.arange(len(codes)), side="right")) == 0] == codes[:-1][np.diff(np.searchsorted(starts, np.arange(len(codes)), side="right")) == 0]).all()
