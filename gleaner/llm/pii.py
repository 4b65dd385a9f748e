"""Personal data: patterns of form, and bootstrapped extraction by context. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, only, stored

#: In the order of the result. Possessive and anchored at the start of a run, so that no text takes more than linear time or deep recursion; they find what the plain forms find from left to right.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method adds.
ADDED = "id"
#: A token that holds a digit or an @ may be an identifier.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_SP, _NS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Least length of an added identifier, distinct trusted instances and precision of a pattern, trust of an instance, rounds.
LENGTH, SUPPORT, PRECISION, TRUST, ROUNDS = 6, 3, 0.6, 0.8, 3
#: Characters before a token that are looked at first for its neighbour; words that are broadcast at most.
NEAR, BROADCAST = 200, 200_000


def _plain(word: str) -> str:
    return f"lower(translate({word}, '123456789', '000000000'))"


def _cuts(kind: str, regex: str, guard: str) -> str:
    """SQL for the matches of one kind: number, length of the text since the last one, match, neighbours."""
    found = f"named_struct('g', split(t, r'{regex}', -1), 'm', regexp_extract_all(t, r'{regex}', 0))"
    left = right = "''"
    if kind == "token":
        # A gap begins and ends with white space where a token is: its last and first words, or the tokens beyond it. A
        # word that stands whole in the gap's last NEAR characters needs no look at the rest.
        last = lambda part, before: f"nullif(regexp_extract({part}, r'{before}({_NS}++){_SP}++$', 1), '')"
        left = f"coalesce({last(f'right(p.g[i], {NEAR})', _SP)}, {last('p.g[i]', f'(?<!{_NS})')}, if(i > 0, p.m[i - 1], ''))"
        right = f"coalesce(nullif(regexp_extract(p.g[i + 1], r'^{_SP}++({_NS}++)', 1), ''), if(i + 1 < size(p.m), p.m[i + 1], ''))"
        left, right = _plain(left), _plain(right)
    each = f"transform(p.m, (m, i) -> named_struct('kind', '{kind}', 'i', i, 'g', length(p.g[i]), 'm', m, 'l', {left}, 'r', {right}))"
    none = "cast(array() as array<struct<kind:string,i:int,g:int,m:string,l:string,r:string>>)"
    return f"if({guard}, transform(array({found}), p -> {each})[0], {none})"


def _hits(docs: DataFrame, id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    d = only(docs, doc_id=id, t=text, **{f"kept_{c}": c for c in keep}).withColumn("t", F.coalesce("t", F.lit("")))
    guards = {"email": "contains(t, '@')", "phone": "contains(t, '+')", "ip": "digits", "card": "digits", "token": "digits or contains(t, '@')"}
    d = d.withColumn("digits", F.expr("t rlike '[0-9]'"))
    all_ = ", ".join(_cuts(k, r, guards[k]) for k, r in {**KINDS, "token": TOKEN}.items())
    return stored(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *(f"kept_{c}" for c in keep), F.expr(f"flatten(array({all_}))").alias("hits")), "hits")


def _spans(hits: DataFrame) -> DataFrame:
    """(rid, kind, start, end, m, l, r) of the matches that hold, and of tokens with `seed`: part of such a match."""
    one = hits.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    line = Window.partitionBy("rid", "kind").orderBy("i")
    one = one.withColumn("end", F.sum(F.col("g") + F.length("m")).over(line)).withColumn("start", F.col("end") - F.length("m"))
    digits = "regexp_replace(m, '[^0-9]', '')"
    luhn = f"aggregate(sequence(1, length({digits})), 0, (z, k) -> z + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9), cast(substring({digits}, length({digits}) - k + 1, 1) as int) + if(k % 2 = 0, 11, 1))) % 10 = 0"
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    holds = f"case kind when 'card' then {luhn} when 'phone' then length({digits}) between 8 and 15 when 'ip' then m rlike r'^{part}(?:\\.{part}){{3}}$' else true end"
    one = one.where(F.expr(holds)).select("rid", "kind", "start", "end", "m", "l", "r")
    base = F.col("kind") != "token"
    by = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    back = Window.partitionBy("rid").orderBy(F.col("start").desc(), F.col("end").desc())
    behind = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumns({"before": before, "behind": behind}).withColumn("seed", F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("behind") < F.col("end"), F.lit(False))).drop("before", "behind")


def _patterns(edges: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(side, word) of the patterns that are trusted after ROUNDS rounds.

    A pattern is a word to one side of a token; every place where the word stands in the corpus counts as one of its
    extractions, so a common word is no pattern however many seeds stand by it. Rounds: a pattern's precision is the
    trust of what it extracts over all its places; an instance that is no seed is trusted as far as its trusted
    patterns, taken as independent, vouch for it."""
    firm = edges.where("seed").groupBy("side", "word").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    if firm.isEmpty():
        return firm.select("side", "word")
    # A pattern's support is at most the number of its instances, so words with fewer are none and need no count.
    able = stored(edges.groupBy("side", "word").agg(F.count("*").alias("k")).where(F.col("k") >= SUPPORT).select("word").distinct(), "able")
    words = only(docs, t=text).select(F.explode(F.split(F.expr(_plain("t")), f"{_SP}+")).alias("word"))
    if able.count() <= BROADCAST:
        places = words.join(F.broadcast(able), "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    else:  # counts of all words, and none of their places, travel
        places = words.groupBy("word").agg(F.count("*").alias("places")).join(able, "word")
    edges = stored(edges.join(stored(places, "places"), "word"), "graph")
    trust = edges.groupBy("inst").agg(F.max(F.col("seed").cast("double")).alias("c"))
    for _ in range(ROUNDS):
        trust = stored(trust, "trust")
        rated = edges.join(trust, "inst").groupBy("side", "word").agg((F.sum(F.col("n") * F.col("c")) / F.max("places")).alias("p"), F.sum((F.col("c") >= TRUST).cast("long")).alias("support"))
        rated = stored(rated.where((F.col("p") >= PRECISION) & (F.col("support") >= SUPPORT)), "rated")
        vouched = edges.join(rated, ["side", "word"], "left").groupBy("inst").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("p", F.lit(0.0)), F.lit(0.999)))))).alias("c"))
        trust = vouched
    return rated.select("side", "word")


def found(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(rid, doc_id, kept_NAME for each column in keep, spans array<struct<o int, start, end, kind>>) for each row, base spans and added ones in the
    order of kinds and starts; offsets count code points, ends are exclusive."""
    hits = _hits(docs, id, text, keep)
    spans = stored(_spans(hits), "spans")
    tokens = spans.where("kind = 'token'").withColumn("inst", F.lower(F.regexp_extract("m", r"[A-Za-z0-9@+](?:.*[A-Za-z0-9])?", 0))).where(F.length("inst") >= 1)
    sides = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("l").alias("word")), F.struct(F.lit("R").alias("side"), F.col("r").alias("word"))))
    edges = tokens.select("inst", "seed", sides.alias("s")).where("s.word <> ''").groupBy("s.side", "s.word", "inst").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    trusted = _patterns(stored(edges, "edges"), docs, text)
    new = tokens.where(~F.col("seed") & (F.length("inst") >= LENGTH)).select("rid", "start", "m", "inst", sides.alias("s")).select("rid", "start", "m", "inst", "s.side", "s.word").join(trusted, ["side", "word"], "left_semi")
    # The junk around an identifier stays outside.
    first = F.length(F.regexp_extract("m", r"^[^A-Za-z0-9@+]*", 0))
    new = new.select("rid", F.lit(ADDED).alias("kind"), (F.col("start") + first).alias("start"), (F.col("start") + first + F.length("inst")).alias("end")).distinct()
    order = F.expr("case kind " + " ".join(f"when '{k}' then {n}" for n, k in enumerate([*KINDS, ADDED])) + " end")
    every = spans.where("kind <> 'token'").select("rid", "kind", "start", "end").union(new)
    lists = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<o:int,start:bigint,end:bigint,kind:string>>)")
    rows = lambda some: hits.where(some).select("rid", "doc_id", *(f"kept_{c}" for c in keep))
    # Most rows have nothing to be joined, and aren't moved.
    met = rows(F.size("hits") > 0).join(lists, "rid", "left").withColumn("spans", F.coalesce("spans", none))
    return met.unionByName(rows(F.size("hits") == 0).withColumn("spans", none))


def extracted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs. Counts are of base spans.

    Null and empty texts have no spans; repeated rows and repeated or null ids stay rows of their own; an empty table
    gives an empty result. Very long texts are searched whole, in linear time; of spans with one start the shorter
    comes first."""
    f = found(docs, id, text)
    told = lambda c: F.expr(f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    f = f.withColumn("base", F.expr(f"filter(spans, s -> s.kind <> '{ADDED}')"))
    return f.select("doc_id", *counts, F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def redacted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; of spans that overlap the first (by start) names it."""
    f = found(docs, id, text, keep=tuple(docs.columns))
    whole = f"`kept_{text}`"
    steps = f"aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), named_struct('at', 0L, 'out', cast(array() as array<string>)), (z, s) -> if(s.start >= z.at, named_struct('at', s.end, 'out', concat(z.out, array(substring({whole}, cast(z.at + 1 as int), cast(s.start - z.at as int)), concat('<', upper(s.kind), '>')))), named_struct('at', greatest(z.at, s.end), 'out', z.out)), z -> array_join(concat(z.out, array(substring({whole}, cast(z.at + 1 as int)))), ''))"
    new = F.when(F.size("spans") > 0, F.expr(steps)).otherwise(F.col(whole))
    return f.select(*(new.alias(c) if c == text else F.col(f"`kept_{c}`").alias(c) for c in docs.columns))
