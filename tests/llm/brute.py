"""Plain, slow versions of the registered queries, to compare with; rows are dicts of ``documents`` or ``pages``."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def utf8(text):
    return (text or "").encode("utf-8", "surrogatepass")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def last(number):
    """Sorts null after every number."""
    return (number is None, number or 0)


def substring_dedup(docs, width=13):
    words = [WORD.findall(d["text"] or "") for d in docs]
    first = {}
    for d, w in zip(docs, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, (True, 0)) if key in first else last(d["doc_id"]), last(d["doc_id"]))
    out = []
    for d, w in zip(docs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < last(d["doc_id"]):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        out.append((d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(utf8(d["text"])).hexdigest()))
    return out


def exact_dedup(docs):
    groups = defaultdict(list)
    for at, d in enumerate(docs):
        groups[BLANK.sub("", d["text"] or "")].append((-len(d["text"] or ""), last(d["doc_id"]), at))
    out = [None] * len(docs)
    for body, members in groups.items():
        best = min(members)
        for member in members:
            kept = member == best
            out[member[2]] = (docs[member[2]]["doc_id"], docs[best[2]]["doc_id"], len(members), kept, hashlib.sha256(body.encode()).hexdigest())
    return out


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: (len(r[0]), len(r[1])), default=None)


def token_output(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        out.append((d["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def fingerprint(text, width):
    words = WORD.findall(ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode("utf-8"), 42)
        ones.update(i for i in range(64) if h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def simhash(docs, width=3, radius=2):
    prints = [fingerprint(d["text"], width) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = components(len(docs), links)
    least = {}
    for d, r in zip(docs, root):
        least[r] = min(least.get(r, (True, 0, 1)) if r in least else last(d["doc_id"]), last(d["doc_id"]))
    return [(d["doc_id"], f"{p:016x}", None if least[r][0] else least[r][1]) for d, p, r in zip(docs, prints, root)]


def base_scores(docs):
    """op5: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score); a null id counts as empty text."""
    end = None
    counts = Counter()
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 10 == 0 for d in docs]
    tokens = [[*WORD.findall(ascii_lower(d["text"])), end] for d in docs]
    for h, t in zip(held, tokens):
        if not h:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    score = lambda t: sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
    return [(d["doc_id"], h, len(t), sum(counts[x] > 0 for x in t), n, score(t)) for d, h, t in zip(docs, held, tokens)]
