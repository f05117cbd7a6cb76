import random

from folioscan.llm import leaks as L

VOCAB = [f"w{i}" for i in range(40)] + list("會議記錄審查經費")


def units(text):
    out, cur = [], ""
    for c in text:
        ideo = any(a <= ord(c) <= b for a, b in L.IDEOGRAPHS)
        if c.isalnum() and not ideo:
            cur += c.lower()
        else:
            if cur:
                out.append(cur)
            cur = ""
            if ideo:
                out.append(c)
    return out + ([cur] if cur else [])


def brute(docs, items):
    known = {}
    for i, t in items:
        u = units(t or "")
        for k in range(len(u) - 14):
            known.setdefault(tuple(u[k : k + 15]), set()).add(i)
    out = set()
    for d, t in docs:
        u = units(t or "")
        for k in range(len(u) - 14):
            out |= {(d, i) for i in known.get(tuple(u[k : k + 15]), ())}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(80):
        t = text(60)
        if i % 2:
            u = rng.choice(items[:30])[1].split()
            cut = rng.randint(10, len(u)) if len(u) > 10 else len(u)
            t = text(20) + ", " + "-".join(u[:cut]).upper() + ". " + text(20)
        docs.append((i, t, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (1, docs[1][1], "x")]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in L.leaks(a, b).collect()]
    assert set(got) == brute([d[:2] for d in docs], items) and len(got) == len(set(got)) and got


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_BLOCK", 2)
    item = " ".join(f"u{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(i, item) for i in range(5)], "item_id long, text string")
    assert sorted(map(tuple, L.leaks(docs, items).collect())) == [(1, i) for i in range(5)]
    assert L.leaks(docs.where("false"), items).count() == 0
    assert L.leaks(docs, items.where("false")).count() == 0


def test_repetitions():
    assert L.repetitions(0.99, 1.0) == 1
    r = L.repetitions(0.99, 0.4)
    assert 1 - 0.6**r >= 0.99 > 1 - 0.6 ** (r - 1)


def distance(a, b):
    """The least edit distance of a and any beginning of b."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return min(last)


def test_edited_items(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in range(40)]
    docs, near = [], set()
    for d in range(200):
        i, t = rng.choice(items)
        u = t.split()[:15]
        for _ in range(d % 4):
            k = rng.randrange(len(u))
            u[k : k + rng.choice((0, 1))] = [rng.choice(vocab)] if rng.random() < 0.6 else []
        docs.append((d, " ".join([rng.choice(vocab) for _ in range(10)] + u)))
    for d, t in docs:
        u = units(t)
        for i, x in items:
            w = units(x)
            if any(distance(w[a : a + 15], u[b : b + 17]) <= 2 for a in range(6) if set(w[a : a + 15]) & set(u) for b in range(len(u))):
                near.add((d, i))
    got = {tuple(r) for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), distance=2).collect()}
    assert got <= near and len(near) > 100 and len(got) >= 0.97 * len(near)
