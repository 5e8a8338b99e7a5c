"""The operators' definitions in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def le(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def quality(rows, min_docs=100, fence=3):
    """{row number: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)}"""
    found, rates = [], []
    for text, _, _ in rows:
        ws = words(text)
        windows = defaultdict(list)
        for i in range(len(ws) - 4):
            windows[tuple(ws[i : i + 5])].append(i)
        repeat = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        n, dup = len(ws), len(lines) - len(set(lines))
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        chars = sum(map(len, ws))
        failed = n < 10 or 100 * len(repeat) > 20 * n
        found.append((n, chars, symbols, dup, len(repeat), failed))
        rates.append([1000 * x // y if y else 0 for x, y in ((chars, n), (symbols, n), (dup, len(lines)), (len(repeat), n))])

    def bucket(v):
        return v - v % (1 << max(v.bit_length() - 6, 0))

    groups = defaultdict(list)
    for (_, lang, source), rate, counts in zip(rows, rates, found):
        if not counts[-1]:
            for key in ((lang, source), (lang,), ()):
                groups[key].append([bucket(v) for v in rate])
    done = []
    for (_, lang, source), rate, counts in zip(rows, rates, found):
        keys = [k for k in ((lang, source), (lang,), ()) if len(groups.get(k, ())) >= min_docs] or [()]
        kept = not counts[-1]
        for i, (least, low) in enumerate(((500, True), (50, False), (100, False), (50, False))):
            if kept and (lang, source) in groups:
                values = sorted(v[i] for v in groups[keys[0]])
                q1, q3 = (values[math.ceil(q * len(values) / 4) - 1] for q in (1, 3))
                spread = max(q3 - q1, least)
                kept = rate[i] <= q3 + fence * spread and (not low or rate[i] >= q1 - fence * spread)
        done.append((*counts, kept))
    return done


def without_repeats(docs, window=20):
    """{doc_id: (n_words, n_removed, kept words)} of {doc_id: text}"""
    seen, found = set(), {}
    for doc in sorted(docs):
        ws = words(docs[doc])
        gone = set()
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        found[doc] = len(ws), len(gone), [w for i, w in enumerate(ws) if i not in gone]
    return found


def shingles(text, length):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < length:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + length]) for i in range(len(ws) - length + 1)}


def components(docs, length, threshold):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}"""
    sets = {d: shingles(t, length) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    shared = Counter()
    for ids in at.values():
        shared.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def exact(rows):
    """{(doc_id, sha): (keep_id, group_size)} of (doc_id, text)"""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[sha(SPACES.sub(" ", text or ""))].append(doc)
    return {(d, h): (min(ids), len(ids)) for h, ids in groups.items() for d in ids}


def pieces(docs, capacity=2048):
    """{(doc_id, piece): (start, length, crc)} of {doc_id: text}"""
    coder, found = tokenizer(), {}
    for doc, text in docs.items():
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        for i, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            found[doc, i] = start, len(cut), zlib.crc32(le(cut))
    return found
