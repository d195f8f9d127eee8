"""Plain versions of the operators, and the tables that the tests share."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, weight string, digest string, `__row` int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(seed=5, n=120):
    """Small documents: repeats of one passage, copies, near copies, nulls, empty, periodic and repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4))) for _ in range(12)]
    passage = " ".join(rnd.choice(words) for _ in range(150))
    texts = []
    for i in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))
        if i % 3 == 0:
            k, a = rnd.randint(0, len(t)), rnd.randint(0, 100)
            t = t[:k] + passage[a:a + rnd.randint(150, 400)] + t[k:]
        texts.append(t.replace(" b ", "\n", 2))
    long = " ".join(rnd.choice(words) + str(i) for i in range(400))
    texts += [None, "", " \t\n", "a" * 199, "a" * 200, "a" * 201, "b" * 1000, "xy" * 300, texts[3], texts[3], "lorem ipsum dolor " * 40 + "tail",
              "lorem ipsum dolor " * 30 + "t2", "c" * 200, "c" * 200, long, long.upper(), long + " more", long.replace("7", "seven", 3), "one two", "One\tTWO", "###"]
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s1", "s1", "s2", "s0", "ß", None]), len(t or ""), i, "w", "d", i) for i, t in enumerate(texts)]
    out += [out[-1], out[-1]]                               # repeated rows
    out += [(None, "no id here " * 30, "en", "s1", None, None, None, None, None)]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def n_words(t):
    return len(WORD.findall(t or ""))


def repeats(texts, length=200):
    """(bytes, removed, spans, sha256) of every text without the bytes that lie in repeated strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = WORD.findall(t)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_groups(docs):
    """Per document its number of shingles and the smallest id it is linked with."""
    sets = [(i, shingles(t)) for i, t in docs]
    where, parent = defaultdict(list), list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for k, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j][1]) - c):
                parent[find(k)] = find(j)
        for x in s:
            where[x].append(k)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]
