"""Small tables with hard cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
#: Names that operators use inside; the tables have them as further columns.
CLASHING = ["row", "doc", "part", "kind", "label", "token", "class", "size", "block", "line", "n", "nth", "e", "slice", "print", "y", "pieces"]


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(AZ))


def sample_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉTÉ", "naïve", "日本", "x!y", "I'll", "don't"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randrange(3, 120)) for _ in range(14)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in b.split(" ")) for b in base[:8] for _ in range(3)]
    spaced = [b.replace(" ", "  ", 3) for b in base[:4]]
    odd = [None, "", "   ", "\n\n", "one", "one", "a b c d", "A b C d", "a b c d e", "\x00\x01 z", "é" * 3000, "long " * 60_000, base[0], base[0].upper()]
    return base + near + spaced + odd + base[:3]


def documents(spark, texts=None, ids=None):
    from pyspark.sql import functions as F

    texts = sample_texts() if texts is None else texts
    ids = list(range(100, 100 + len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or "")) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3)


def no_documents(spark):
    return documents(spark, ["x"]).where("false")


def shingle_sets(docs, k=5):
    out = {}
    for i, t in docs:
        w = words(t, r"[^\x20\x09-\x0d]+")
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(docs):
    sets, parent, holders = shingle_sets(docs), {i: i for i, _ in docs}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sorted(sets.items()):
        shared = Counter(j for g in s for j in holders[g])
        for j, o in shared.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(docs, items):
    pattern, out = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", {}
    grams = defaultdict(set)
    for item, t in items:
        w = words(t, pattern)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i : i + k])].add(str(item))
    lengths = {len(g) for g in grams}
    for i, t in docs:
        w, hit, found = words(t, pattern), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if at := grams.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= at
        out[i] = (len(w), len(hit), sorted(found))
    return out


def exact_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def edits_apart(a, b, bound):
    """Whether at most ``bound`` edits lie between two strings."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return len(a) + len(b) <= bound
    return bound > 0 and any(edits_apart(x, y, bound - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def kept_lines(docs, edits=1, least=(8, 40)):
    first = {}
    for i, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(BLANKS):
                first.setdefault(line, (i, n))

    def close(a, b):
        bound = sum(min(len(a), len(b)) >= x for x in least[:edits])
        return abs(len(a) - len(b)) <= bound and edits_apart(a, b, bound)

    far = {x for x in first for y in first if first[y] < first[x] and close(x, y)}
    out = {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for n, x in enumerate(lines) if not x.strip(BLANKS) or (first[x] == (i, n) and x not in far)]
        out[i] = (len(lines), len(kept), "\n".join(kept) if t is not None else None)
    return out


def packed_ids(texts: dict, capacity: int = 2048) -> dict:
    from tokenizers import Tokenizer

    from tomeatlas.llm.queries import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = {}
    for i, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        out |= {(i, k // capacity): min(capacity, n - k) for k in range(0, n, capacity)}
    return out


def words_as_written(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text)
