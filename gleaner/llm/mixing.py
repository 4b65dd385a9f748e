"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, only, stored

#: No source is repeated more often; words of a block at least; blocks of a mix at most; rows of a stretch of the permuted line.
REPEATS, BLOCK, BLOCKS, STRETCH = 3, 1_024, 1 << 20, 512
#: Primes that step through a source's blocks; words of a shard that are shuffled at once.
FACTORS, SLOT = (1_000_003, 999_983), 2 << 20
TAKEN = "aggregate(pieces, 0L, (z, v) -> z + v.n_words)"


def _sizes(docs: DataFrame, id: str, text: str, source: str, seed: int, keep: tuple[str, ...]) -> DataFrame:
    d = only(docs, doc_id=id, text=text, source=source, **{f"kept_{c}": c for c in keep})
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # Rows alike in all that is kept are alike to the mix.
    tie = F.xxhash64(*(f"kept_{c}" for c in keep)) if keep else F.lit(0).cast("long")
    return stored(d.select("doc_id", *(f"kept_{c}" for c in keep), F.col("source").cast("string").alias("source"), F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).cast("long"), F.lit(0)).alias("size"), key.alias("key"), tie.alias("tie")).withColumn("size", F.greatest("size", F.lit(0))), "sizes")


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size) -> also rank (from 0, by code point, null last), weight 1, 2, 3, 1, ... and target.

    A source's target is level * weight, but REPEATS times its size at most; the level is such that targets sum up to
    all sizes. With sources by falling need for a limit, it is what is left for those behind a source over their
    weights, at the first source that this level doesn't fill. One row per source is all that is ordered here."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = by_source.withColumn("rank", F.row_number().over(every) - 1)
    s = s.withColumns({"weight": F.col("rank") % 3 + 1, "cap": F.col("source_size") * REPEATS})
    line = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    return s.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).select("source", "source_size", "rank", "weight", "target")


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL for how many good ones are among the draws, where u (in 0 to 1) falls on the distribution. Weights run over
    12 deviations to either side of the mode, from 1 at the low end; beyond them lies less than a double tells."""
    lo = f"greatest(0L, {draws} + {good} - {total})"
    hi = f"least({good}, {draws})"
    mode = f"cast(floor(({draws} + 1D) * ({good} + 1D) / ({total} + 2D)) as bigint)"
    wide = f"cast(ceil(12 * sqrt(greatest(0D, 1D * {draws} * {good} / {total} * (1 - 1D * {good} / {total}) * ({total} - {draws}) / greatest(1L, {total} - 1)))) as bigint) + 12"
    step = f"(({good} - k) * 1D * ({draws} - k) / ((k + 1D) * ({total} - {good} - {draws} + k + 1)))"
    ks = "if(p.b > p.a, sequence(p.a, p.b - 1), cast(array() as array<bigint>))"
    sum_ = f"aggregate({ks}, named_struct('w', 1D, 't', 1D), (z, k) -> named_struct('w', z.w * {step}, 't', z.t + z.w * {step}), z -> z.t)"
    pick = f"aggregate({ks}, named_struct('w', 1D, 'c', 1D, 'x', p.a), (z, k) -> if(z.c >= {u} * t, z, named_struct('w', z.w * {step}, 'c', z.c + z.w * {step}, 'x', k + 1)), z -> z.x)"
    span = f"named_struct('a', greatest({lo}, {mode} - ({wide})), 'b', least({hi}, {mode} + ({wide})))"
    return f"if({total} = 0, 0L, {_let('p', span, _let('t', sum_, pick))})"


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row (q array<long>: blocks of each source) -> (shard, x array<long>), shards rows of equal sums (give or
    take one): each node of the tree deals its blocks to its halves as a draw without replacement would, so rows and
    sources both keep their exact sums."""
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q", F.expr("aggregate(q, 0L, (z, v) -> z + v)").alias("m"))
    u = f"((cast(conv(substring(md5(concat_ws(':', '{seed}', lo, hi, i)), 1, 12), 16, 10) as double) + 0.5D) / {1 << 48}D)"
    drawn = _hypergeometric("q[i]", "z0.r", "z0.d", u)
    deal = (
        "aggregate(if(size(q) > 0, sequence(0, size(q) - 1), cast(array() as array<int>)), named_struct('r', total, 'd', part, 'x', cast(array() as array<bigint>)), "
        f"(z0, i) -> {_let('h', drawn, "named_struct('r', z0.r - q[i], 'd', z0.d - h, 'x', concat(z0.x, array(h)))")}, z0 -> z0.x)"
    )
    bound = lambda x: f"cast(floor(m * cast({x} as decimal(20,0)) / {shards}) as bigint)"
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        nodes = nodes.withColumn("mid", F.expr("cast((lo + hi) div 2 as int)")).withColumns({"total": F.expr("aggregate(q, 0L, (z, v) -> z + v)"), "part": F.expr(f"{bound('mid')} - {bound('lo')}")})
        nodes = nodes.withColumn("l", F.when(F.col("hi") - F.col("lo") > 1, F.expr(deal)))
        halves = F.expr("if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'q', l), named_struct('lo', mid, 'hi', hi, 'q', zip_with(q, l, (a, b) -> a - b))), array(named_struct('lo', lo, 'hi', hi, 'q', q)))")
        nodes = nodes.select("m", F.explode(halves).alias("n")).select("n.lo", "n.hi", "n.q", "m")
    return nodes.select(F.col("lo").alias("shard"), F.col("q").alias("x"))


def _drawn(docs: DataFrame, id: str, text: str, source: str, shards: int, seed: int, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """draws(), and the words of all rows."""
    rows = _sizes(docs, id, text, source, seed, keep)
    n = rows.count()
    bits = min(24, max(0, math.ceil(math.log2(max(1, n) / STRETCH)))) if n > STRETCH else 0
    rows = rows.withColumn("stretch", F.conv(F.substring("key", 1, 6), 16, 10).cast("long").bitwiseAND((1 << 24) - 1))
    rows = rows.withColumn("stretch", F.shiftright("stretch", 24 - bits))
    per = stored(rows.groupBy("source", "stretch").agg(F.sum("size").alias("words")), "stretches")
    sources = stored(targets(per.groupBy("source").agg(F.sum("words").alias("source_size"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(BLOCK, -(-total // BLOCKS))
    sources = sources.withColumn("take", F.round("target").cast("long"))
    s = "source_size"
    sources = sources.withColumns({"n": F.expr(f"cast(ceil(source_size / {block}) as bigint)"), "whole": F.expr(f"if({s} = 0, 0L, take div {s})")})
    sources = sources.withColumns({"rest": F.expr(f"take - whole * {s}"), "part": F.expr(f"cast(ceil((take - whole * {s}) / {block}) as bigint)")})
    sources = sources.withColumn("q", F.expr("whole * n + part"))
    quotas = sources.agg(F.expr("transform(array_sort(collect_list(struct(rank, q))), v -> v.q)").alias("q"))
    dealt = stored(split(quotas, shards, seed), "split").select("shard", F.posexplode("x").alias("rank", "n"))
    dealt = dealt.groupBy("rank").agg(F.expr("transform(array_sort(collect_list(struct(shard, n))), v -> v.n)").alias("n"))
    bounds = "aggregate(n, cast(array(0L) as array<bigint>), (z, v) -> concat(z, array(element_at(z, -1) + v)))"
    sources = sources.join(dealt.select("rank", F.expr(bounds).alias("bounds")), "rank")
    # In the pass of the rest, shard k's run stands at starts[k] of the permuted blocks and has runs[k] of them.
    before = "greatest(v - whole * n, 0L)"
    sources = sources.withColumn("starts", F.expr(f"transform(slice(bounds, 1, {shards}), (v, k) -> {before} + (n - part) * k div {shards})"))
    sources = sources.withColumn("runs", F.expr(f"transform(slice(bounds, 1, {shards}), (v, k) -> greatest(bounds[k + 1] - whole * n, 0L) - {before})"))
    sources = stored(sources.select("source", "source_size", "target", "n", "whole", "rest", "part", "bounds", "starts", "runs"), "quotas")

    in_source = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("start", F.coalesce(F.sum("words").over(in_source), F.lit(0))).drop("words")
    starts = stored(starts, "starts").withColumnsRenamed({"source": "s", "stretch": "t"})
    in_stretch = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(in_stretch), F.lit(0)))
    placed = placed.join(starts, placed.source.eqNullSafe(starts.s) & (placed.stretch == starts.t)).withColumn("at", F.col("at") + F.col("start")).select("doc_id", *(f"kept_{c}" for c in keep), "source", "size", "at")
    sources = sources.withColumnRenamed("source", "s")
    placed = placed.join(sources, placed.source.eqNullSafe(sources.s)).drop("s")
    # Block b of pass e stands at (b * factor + seed + e) mod (n - 1) among its source's, the last block at the end; the
    # factor has no divisor in common with n - 1.
    place = f"if(b = n - 1, b, (b * if((n - 1) % {FACTORS[0]} = 0, {FACTORS[1]}L, {FACTORS[0]}L) + {seed} + e) % (n - 1))"
    steps = f"sequence(1, {max(1, math.ceil(math.log2(shards)) + 1)})"
    last = lambda array, x: f"aggregate({steps}, named_struct('lo', 0L, 'hi', {shards}L), (z, k) -> if(z.hi - z.lo <= 1, z, if({array}[(z.lo + z.hi) div 2] <= {x}, named_struct('lo', (z.lo + z.hi) div 2, 'hi', z.hi), named_struct('lo', z.lo, 'hi', (z.lo + z.hi) div 2))), z -> z.lo)"
    shard = f"if(c.e < whole, {last('bounds', 'c.e * n + c.p')}, {last('starts', 'c.p')})"
    cuts = f"""flatten(transform(sequence(0, {REPEATS - 1}), e -> if(size = 0 or e > whole or (e = whole and rest = 0), cast(array() as array<struct<e:int,b:bigint,p:bigint>>),
      transform(sequence(at div {block}, (at + size - 1) div {block}), b -> named_struct('e', e, 'b', b, 'p', {place})))))"""
    placed = placed.withColumn("cuts", F.expr(cuts))
    # Of the rest's pass a shard holds runs[k] blocks from starts[k] on; the last of all is cut where the target is met.
    placed = placed.withColumn("cuts", F.expr(f"transform(cuts, c -> named_struct('c', c, 'shard', cast({shard} as int)))"))
    placed = placed.withColumn("cuts", F.expr("filter(cuts, x -> x.c.e < whole or x.c.p < starts[x.shard] + runs[x.shard])"))
    nth = "(x.c.p - starts[x.shard] + greatest(bounds[x.shard] - whole * n, 0L))"
    until = f"x.c.b * {block} + if(x.c.e = whole and {nth} = part - 1, rest - (part - 1) * {block}, {block})"
    low, high = f"greatest(x.c.b * {block}, at)", f"least({until}, at + size)"
    out = F.expr(f"filter(transform(cuts, x -> named_struct('shard', x.shard, 'block', x.c.b, 'epoch', x.c.e, 'from_word', {low} - at, 'n_words', {high} - {low})), v -> v.n_words > 0)")
    return placed.select("doc_id", *(f"kept_{c}" for c in keep), "source", "size", "source_size", "target", out.alias("pieces")), total


def draws(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, pieces): what the mix takes of each row of docs; and kept_NAME for
    each further column of docs in keep.

    A piece is (shard, block, epoch, from_word, n_words). A source's rows form a line of words in an order drawn by
    the seed, cut into blocks. A target grants whole passes over the line and a rest. The tree deals the blocks of all
    passes to shards; each shard then draws as many as it was granted, as a run of that pass's permutation of blocks,
    runs of different shards being disjoint. In the pass of the rest the runs of shards lie apart, since what
    is not drawn is spread evenly between them, so which blocks are drawn hangs on the tree. The last block drawn of that pass is cut short, so a
    source's pieces sum up to its rounded target; a line's last and shorter block is drawn only where all others are.
    No row gives more than REPEATS times its words.

    Null texts have size 0; null sources are one source, the last; ids may be null or repeat, and repeated rows are
    rows of their own. An empty table gives an empty result; with no words all targets are 0. Two runs give the same
    pieces, whatever the partitions. No row holds more than the pieces of one document; a very long one spans many blocks."""
    return _drawn(docs, id, text, source, shards, seed, keep)[0]


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """draws() with taken, the words of all pieces."""
    return draws(docs, id, text, source, shards, seed, keep).withColumn("taken", F.expr(TAKEN))


def shards_of(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int = 64, seed: int = 7, keep: tuple[str, ...] = (), slot: int = SLOT) -> DataFrame:
    """(shard, doc_id, kept columns, source, block, epoch, from_word, n_words, text): the mix itself, a row for each piece with
    its words cut from the text, white space between them as it stands, as often as the mix takes them.

    Shards are shuffled locally: rows of a shard are put in the order of a hash, and that order is cut into slots of
    about `slot` words, which are partitions' units; so a shard may be larger than a task."""
    m, words = _drawn(docs, id, text, source, shards, seed, (text, *(c for c in keep if c != text)))
    slots = max(1, -(-words // (slot * shards)))
    whole = f"`kept_{text}`"
    # All words with the white space behind them; what stands before the first word belongs to no piece.
    split = f"regexp_extract_all({whole}, r'{WORD}[\\x20\\x09-\\x0D]*', 0)"
    cut = f"if(p.n_words = size, {whole}, regexp_replace(array_join(slice(w, cast(p.from_word + 1 as int), cast(p.n_words as int)), ''), r'[\\x20\\x09-\\x0D]+$', ''))"
    pieces = f"if(size(pieces) = 0, cast(array() as array<struct<p:struct<shard:int,block:bigint,epoch:int,from_word:bigint,n_words:bigint>,text:string>>), transform(array(if(exists(pieces, p -> p.n_words < size), {split}, cast(array() as array<string>))), w -> transform(pieces, p -> named_struct('p', p, 'text', {cut})))[0])"
    names = [c for c in keep if c != text]
    out = m.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in names), "source", "size", "source_size", "target", F.explode(F.expr(pieces)).alias("x"))
    out = out.select("x.p.shard", "doc_id", *names, "source", "size", "source_size", "target", "x.p.block", "x.p.epoch", "x.p.from_word", "x.p.n_words", "x.text")
    o = F.xxhash64(F.lit(seed), "doc_id", "source", "block", "epoch", "from_word", "text")
    out = out.withColumn("o", o).withColumn("slot", F.floor(F.shiftrightunsigned("o", 33) * slots / (1 << 31)))
    return out.repartition(int(min(200_000, shards * slots)), "shard", "slot").sortWithinPartitions("shard", "slot", "o").drop("o", "slot")
