"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def contaminated(docs, items, size=10):
    """(words, hit words, sorted item ids) per (doc_id, text) row."""
    windows = set()
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows |= {(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def fingerprint(text, shingle=3):
    w = [x for x in _BLANK.split((text or "").translate(_LOW)) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids_fps, max_bits=3):
    """Smallest id reachable, per row, comparing all pairs."""
    comp = list(range(len(ids_fps)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids_fps)):
        for j in range(i):
            if (ids_fps[i][1] ^ ids_fps[j][1]).bit_count() <= max_bits:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(ids_fps):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids_fps))]


_TOK = []


def ids(text, end=2):
    if not _TOK:
        _TOK.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return _TOK[0].encode(text or "", add_special_tokens=False).ids + [end]


def crc(part):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


def normal(text):
    return _BLANK.sub(" ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


RULES = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24)}


def secrets(text):
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def restored_lines(rows, ratio=0.005, short_ratio=0.05, least=3, many_words=3):
    """Cleaned text per (doc, host, text) row."""
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    hosts = {}
    for _, host, text in rows:
        if text is not None:
            hosts.setdefault(host, set()).add(text)
    out = []
    for doc, host, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        pages = hosts[host]
        n = lambda line: sum(line in {strip(x) for x in p.split("\n")} for p in pages)
        bad = lambda line: line != "" and n(line) >= least and n(line) > (ratio if len(line.split(" ")) >= many_words else short_ratio) * len(pages)
        out.append((doc, "\n".join(x for x in text.split("\n") if not bad(strip(x)))))
    return out
