import hashlib
import re

import odd

from gleaner.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, r in PLAIN.items() for m in r.finditer(text or "") if holds(k, m[0])]


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c.@d.e x@y@z.org ..@a-b.co a@b..c a@b.c-d.e_f@g.h @a.b a@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.255.0 1.2.3 999.9.9.9.9 é1.1.1.1é 1.2.3.300.4.5.6.7",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111 4111 1111  1111 1111 378282246310005 6011000990139424 4111111111111111-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+1 (555) 123-4567 ++49 30 1234567 +1+1 555 555 5555 +123 +1 555 123 4567 8901 234 +1.2.3.4.5.6.7.8.9 +49 ((((( 1", "😀 a.b@c.de 😀 10.0.0.1 😀+1 555 123 4567", "+" * 3000 + "1" * 3000 + "a@" * 3000, "1-" * 5000, "a." * 4000 + "@b.c", "1." * 5000,
    None, "",
]


def check(rows, docs):
    texts = sorted(rows, key=repr)
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in docs), key=repr)
    want = []
    for i, t in texts:
        b = base(t)
        want.append((i, *(sum(k == x for k, _, _ in b) for x in PLAIN), hashlib.sha256(told(b).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(t)
    for r in docs:
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        assert any(told(x for x in spans if x[0] != pii.ADDED) == told(base(t)) and all(0 <= a < b <= len(t or "") for _, a, b in spans) for t in by[r["doc_id"]])
        assert spans == sorted(spans, key=lambda s: ([*PLAIN, pii.ADDED].index(s[0]), s[1]))


def test_base_spans(spark, sf):
    rows = [(r[0], r[1]) for r in odd.rows()] + [(1000 + k, t) for k, t in enumerate(TRICKY)] + [tuple(r) for r in odd.table(spark, sf, "documents").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, rid string, hits string").repartition(6)
    check(rows, pii.extracted(df).collect())


def test_context_finds_identifiers(spark):
    """`account` stands by known data and by numbers of no known form; `lorem` stands by anything."""
    rows = [(k, f"account user{k}@mail.org then lorem w{k} lorem {k + 100000}") for k in range(20)]
    rows += [(50, "my account ZX-99817-Q closes"), (51, "lorem 7718812 ipsum"), (52, "account none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.extracted(df).collect()}
    assert got[50] == "id:11:21" and rows[20][1][11:21] == "ZX-99817-Q"
    assert got[51] == got[52] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert red[50] == "my account <ID> closes" and red[52] == rows[22][1] and red[3].startswith("account <EMAIL> then")


def test_neighbours_behind_any_white_space(spark):
    rows = [(k, f"account user{k}@mail.org then lorem w{k}") for k in range(20)]
    ways = {"tab": "account\tZX-99817-Q", "line": "account\r\nZX-99817-Q", "far": "account" + " " * 700 + "ZX-99817-Q", "between": "7\tAccount \n ZX-99817-Q", "not": "accounts ZX-99817-Q", "behind": "q" * 50_000 + " account \x0b\x0c ZX-99817-Q"}
    rows += [(100 + k, t) for k, t in enumerate(ways.values())]
    got = {r["doc_id"]: r["spans"] for r in pii.extracted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (way, t) in enumerate(ways.items()):
        assert got[100 + k] == ("" if way == "not" else f"id:{len(t) - 10}:{len(t)}"), way
    # A pattern may be a token itself, and longer than any window.
    name = "x" * 300 + "7"
    rows = [(k, f"{name}\nuser{k}@mail.org") for k in range(20)] + [(30, f"see {name} \t QX-4711-77")]
    got = {r["doc_id"]: r["spans"] for r in pii.extracted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[30] == "id:308:318"


def graph(rows):
    """The added spans by plain loops over the same rules."""
    import math

    blank, plain = r"[\x20\x09-\x0D]", lambda w: w.lower().translate(str.maketrans("123456789", "000000000"))
    edges, places, tokens = {}, {}, []
    for row, (_, text) in enumerate(rows):
        words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        known = [(a, b) for _, a, b in base(text)]
        for k, (at, w) in enumerate(words):
            places[plain(w)] = places.get(plain(w), 0) + 1
            if not re.search("[0-9@]", w):
                continue
            core = re.search(r"[A-Za-z0-9@+](?:.*[A-Za-z0-9])?", w)
            inst = core[0].lower() if core else ""
            if not inst:
                continue
            seed = any(a < at + len(w) and b > at for a, b in known)
            sides = [("L", plain(words[k - 1][1]) if k else ""), ("R", plain(words[k + 1][1]) if k + 1 < len(words) else "")]
            tokens.append((row, at, w, inst, seed, sides))
            for side in sides:
                if side[1]:
                    n, s = edges.get((side, inst), (0, False))
                    edges[side, inst] = (n + 1, s or seed)
    firm = {}
    for (side, _), (n, seed) in edges.items():
        if seed:
            firm[side] = firm.get(side, 0) + 1
    if not any(n >= pii.SUPPORT for n in firm.values()):
        return {}
    trust = {}
    for (_, inst), (_, seed) in edges.items():
        trust[inst] = max(trust.get(inst, 0.0), float(seed))
    for _ in range(pii.ROUNDS):
        total, support = {}, {}
        for (side, inst), (n, _) in edges.items():
            total[side] = total.get(side, 0) + n * trust[inst]
            support[side] = support.get(side, 0) + (trust[inst] >= pii.TRUST)
        rated = {s: t / places[s[1]] for s, t in total.items() if t / places[s[1]] >= pii.PRECISION and support[s] >= pii.SUPPORT}
        vouch, sure = {}, {}
        for (side, inst), (_, seed) in edges.items():
            vouch[inst] = vouch.get(inst, 0.0) + math.log(1 - min(rated.get(side, 0.0), 0.999))
            sure[inst] = sure.get(inst, False) or seed
        trust = {i: 1.0 if sure[i] else 1 - math.exp(v) for i, v in vouch.items()}
    out = {}
    for row, at, w, inst, seed, sides in tokens:
        if not seed and len(inst) >= pii.LENGTH and any(s in rated for s in sides):
            first = at + len(re.match(r"[^A-Za-z0-9@+]*", w)[0])
            out.setdefault(row, []).append((pii.ADDED, first, first + len(inst)))
    return out


def test_added_spans_against_plain_loops(spark, sf):
    rows = [tuple(r) for r in odd.table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows += [(9_000 + k, f"account\tuser{k}@mail.org then lorem w{k} Ref: 10.0.0.{k}") for k in range(30)]
    rows += [(9_100 + k, f"account ZX-9{k}81-Q\nref: AB{k}7-99-{k}") for k in range(9)] + [(9_200, None), (9_201, "account 12345")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: sorted(s for s in r["spans"].split(",") if s.startswith(pii.ADDED)) for r in pii.extracted(df).collect()}
    added = graph(rows)
    assert got == {i: sorted(told([s]) for s in added.get(k, [])) for k, (i, _) in enumerate(rows)}
    assert sum(map(len, added.values())) >= 9


def test_redacted_keeps_rows_and_columns(spark):
    docs = odd.documents(spark)
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.drop("text").collect())) == sorted(map(repr, docs.drop("text").collect()))


def test_empty(spark):
    assert pii.extracted(odd.empty(spark)).count() == 0
    assert pii.redacted(odd.empty(spark)).count() == 0
