"""Quotation linking of messages.

Lines are parsed into quote levels (> marks, blanks between them allowed); maximal runs of one level are passages. The hash of a
passage's normalised lines is joined to the runs of as many consecutive level-0 lines in other messages (quoted lines and lines
without a normal form between them do not count): its source is the latest earlier message of the same conversation with such a
run, else the first message anywhere that has one and comes before in (conv_id, turn). The source of a passage without such a
run is, of all earlier messages that have lines of it, the one with most (then of the same conversation the latest, else the
first). Lines of fewer than 4 signs point to another conversation only as a whole passage that no third conversation has. Lines
without a normal form are part of passages but point to nothing. A message replies to the source of its level-1 passages with most lines; without one, to the turn before it. Threads
and depths come from the parents by pointer doubling, and (thread, depth, conv_id, turn) is the reply order: a parent always
stands before its replies; position counts the messages of a thread in it from 1. Texts are given back without quotes and
without the attribution lines directly above them.

Defined results: null and empty texts have no lines; very long texts, lines and rows of quote marks are read whole; rows without
conv_id or turn are threads of their own at depth 0 and neither quote nor are quoted; rows that repeat a (conv_id, turn) are one
message with several texts, each returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import Ranged, numbered
from .common import durable, table

#: Fixed value: words that end an attribution line above a quotation.
_ATTRIBUTION = r"(?m)^[^\n>]*(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*\n+(?=[ \t]*>)"
_MARKS = r"^[ \t]*>[> \t]*"
#: Shorter lines are linked within the conversation, and elsewhere only where a single other conversation has them.
LEAST = 4
#: Lines of at most so many messages are joined to them one by one; a matter of cost, not of results.
RARE = 64


def parsed(text: Column) -> Column:
    """Array of (level, body) per line, attribution lines left out."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), _ATTRIBUTION, ""), "\n")
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    return F.transform(lines, lambda x: F.struct((F.length(marks(x)) - F.length(F.translate(marks(x), ">", ""))).cast("int").alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))


def normalised(body: Column) -> Column:
    """Lower case, white space as single blanks, other signs than letters and digits dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, rc, rt, depth) from (conv_id, turn, pc, pt): pointers double until they point to roots. A message whose
    pointer has reached its root takes no further part."""
    root = F.col("pc").isNull()
    at = durable(parents.select("conv_id", "turn", F.coalesce("pc", "conv_id").alias("rc"), F.coalesce("pt", "turn").alias("rt"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("there")), "quote-roots")
    while not at.where("not there").isEmpty():
        up = at.select(F.col("conv_id").alias("rc"), F.col("turn").alias("rt"), F.col("rc").alias("nc"), F.col("rt").alias("nt"), F.col("depth").alias("more"), F.col("there").alias("ends"))
        moved = at.where("not there").join(up, ["rc", "rt"]).select("conv_id", "turn", F.col("nc").alias("rc"), F.col("nt").alias("rt"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("there"))
        at = durable(at.where("there").unionByName(moved), "quote-roots")
    return at.drop("there")


def _positions(tree: DataFrame) -> DataFrame:
    """tree with position: place in the thread's reply order. All messages are numbered in order over ranges, and a thread's
    first number is taken away, so that no task has a whole thread."""
    placed = durable(numbered(tree, "rc", "rt", "depth", "conv_id", "turn", name="_number"), "quote-order")
    first = durable(placed.groupBy("rc", "rt").agg(F.min("_number").alias("_first")), "quote-first")
    return placed.join(first, ["rc", "rt"]).withColumn("position", (F.col("_number") - F.col("_first") + 1).cast("long")).drop("_number", "_first")


def _runs(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv_id, turn, key): the digests of passages that stand as consecutive lines in a text. own: (conv_id, turn, txt, i, h),
    i counting the lines of the text. Each line is the start of as many runs as there are lengths of passages that begin with it."""
    lengths = texts.groupBy("h").agg(F.collect_set(F.col("lines").cast("int")).alias("ks"))
    line = F.array_sort(F.collect_list(F.struct("i", "h", F.coalesce("ks", F.array().cast("array<int>")).alias("ks"))))
    rows = own.join(lengths, "h", "left").groupBy("conv_id", "turn", "txt").agg(line.alias("a")).withColumn("hs", F.transform("a", lambda x: x["h"]))
    whole = lambda x, j, k: F.get("a", j + k - 1)["i"] == x["i"] + k - 1
    run = F.flatten(F.transform("a", lambda x, j: F.transform(x["ks"], lambda k: F.when(whole(x, j, k), F.xxhash64(F.slice("hs", j + 1, k))))))
    return rows.select("conv_id", "turn", F.explode(run).alias("key")).where("key is not null").join(texts.select(F.col("digest").alias("key")).distinct(), "key", "left_semi").distinct()


def _source(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked with (sc, st): the latest earlier message of the same conversation that has the key, else the first anywhere that
    has it and comes before (for a short one only if no other conversation has it); rows without one are left out. A key of very many messages makes no pairs."""
    extra = [c for c in asked.columns if c not in ("conv_id", "turn", "key")]
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra]
    events = own.select("conv_id", "turn", "key", F.col("turn").alias("src"), *none).unionByName(asked.withColumn("src", F.lit(None).cast("long")))
    # ranges of (conversation, key): one that a third of all messages share is no single task; of one turn, who asks comes first
    ranged = Ranged(events.withColumn("has", F.col("src").isNotNull()), ("conv_id", "key"), (("turn", False), ("has", False)))
    near = ranged.scan(ranged.rows, own=False, near=("max", F.col("src"))).where("passage is not null").withColumn("src", F.col("near")).drop("near", "has", "_part")
    hit = near.join(own.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.max("conv_id").alias("last")), "key", "left")
    before = F.col("first") < F.struct("conv_id", "turn")
    if "short" in extra:
        before = before & (~F.col("short") | (F.col("first.conv_id") == F.col("last")))
    out = hit.withColumns({"sc": F.when(F.col("src").isNotNull(), F.col("conv_id")).when(before, F.col("first.conv_id")), "st": F.when(F.col("src").isNotNull(), F.col("src")).when(before, F.col("first.turn"))})
    return out.where("sc is not null").drop("src", "first", "last")


def _voted(rest: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, v): the earlier message with most lines of the passage, v.n of them, at (v.sc, v.st). rest:
    (conv_id, turn, passage, h), a row per line; own: (conv_id, turn, h). All earlier messages with a line of the passage count.

    Rare lines are joined to their messages. Of frequent lines a message has one set and a passage one list; the overlap is
    counted once per pair of different sets and lists, and a set stands for its messages as a line does in _source."""
    at = ["conv_id", "turn", "passage"]
    own = durable(own.join(rest.select("h").distinct(), "h", "left_semi"), "quote-sets")
    often = durable(own.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("h"), "quote-often")
    rare = rest.join(often, "h", "left_anti").join(own.select(F.col("conv_id").alias("sc"), F.col("turn").alias("st"), "h"), "h").where(F.struct("sc", "st") < F.struct("conv_id", "turn")).groupBy(*at, "sc", "st").agg(F.count("*").alias("n"))
    lists = rest.join(often, "h", "left_semi").groupBy(*at).agg(F.array_sort(F.collect_list("h")).alias("hs")).withColumn("list", F.xxhash64("hs"))
    sets = own.join(often, "h", "left_semi").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("h")).alias("hs")).withColumn("key", F.xxhash64("hs"))
    lists, sets = durable(lists, "quote-lists"), durable(sets, "quote-sets")
    one = lambda d, k: d.select(k, "hs").dropDuplicates([k]).select(k, F.explode("hs").alias("h"))
    shared = durable(one(lists, "list").join(one(sets, "key"), "h").groupBy("list", "key").agg(F.count("*").alias("o")), "quote-shared")
    more = rare.join(lists.select(*at, "list"), at, "left").join(sets.select(F.col("conv_id").alias("sc"), F.col("turn").alias("st"), "key"), ["sc", "st"], "left").join(shared, ["list", "key"], "left")
    rare = durable(more.select(*at, "sc", "st", (F.col("n") + F.coalesce("o", F.lit(0))).alias("n")), "quote-rare")
    best = rare.groupBy(*at).agg(F.max("n").alias("best"))
    asked = lists.select(*at, "list").join(shared, "list").join(best, at, "left").where(F.col("o") >= F.coalesce("best", F.lit(0))).select(*at, "key", F.col("o").alias("n"))
    votes = rare.unionByName(_source(asked, sets.select("conv_id", "turn", "key")).select(*rare.columns))
    here = F.col("sc") == F.col("conv_id")
    return votes.groupBy(*at).agg(F.max_by(F.struct("n", "sc", "st"), F.struct("n", here, F.when(here, F.col("st")).otherwise(-F.col("sc")), F.when(here, 0).otherwise(-F.col("st")))).alias("v"))


def link(messages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(passages, rows). passages: (conv_id, turn, passage, level, digest, source_conv, source_turn, lines, matched), one row
    per quoted passage; rows: messages in reply order with their texts without quotes."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", parsed(F.col("text")).alias("ls"))
    read = durable(base, "quote-lines")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    each = read.where(whole).withColumn("txt", F.xxhash64("ls")).dropDuplicates(["conv_id", "turn", "txt"])
    lines = each.select("conv_id", "turn", "txt", F.posexplode("ls").alias("pos", "x")).select("conv_id", "turn", "txt", "pos", F.col("x.level").alias("level"), normalised(F.col("x.body")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    quoting = each.where(F.exists("ls", lambda x: x["level"] > 0)).select("conv_id", "turn", "txt")
    order = Window.partitionBy("conv_id", "turn").orderBy("txt", "pos")
    same = (F.col("level") == F.lag("level").over(order)) & (F.col("txt") == F.lag("txt").over(order))
    quoted = lines.join(quoting, ["conv_id", "turn", "txt"], "left_semi").withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("passage", F.sum("_new").over(order))
    near = F.when(F.length("norm") < least, F.xxhash64("h", "conv_id")).otherwise(F.col("h")).alias("near")
    quoted = durable(quoted.where("level > 0").select("conv_id", "turn", "passage", "pos", "level", "norm", "h", near), "quote-quoted")
    known = quoted.where("norm <> ''")
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
    texts = known.groupBy("conv_id", "turn", "passage").agg(hashes.alias("hs"), (F.max(F.length("norm")) < least).alias("short")).select("conv_id", "turn", "passage", F.size("hs").cast("long").alias("lines"), F.xxhash64("hs").alias("digest"), F.col("hs")[0].alias("h"), "short")
    texts = durable(texts, "quote-texts")
    own = lines.where("level = 0 and norm <> ''").withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "turn", "txt").orderBy("pos")))
    own = durable(own.join(known.select("h").distinct(), "h", "left_semi").select("conv_id", "turn", "txt", "i", "h", near), "quote-own")
    exact = _source(texts.select("conv_id", "turn", "passage", "short", F.col("digest").alias("key")), _runs(own, texts))
    found = durable(texts.drop("h", "short").join(exact.drop("key", "short"), ["conv_id", "turn", "passage"], "left"), "quote-exact")
    chosen = _voted(known.join(found.where("sc is null"), ["conv_id", "turn", "passage"], "left_semi").select("conv_id", "turn", "passage", F.col("near").alias("h")), own.select("conv_id", "turn", F.col("near").alias("h")).distinct())
    matched = F.when(F.col("sc").isNotNull(), F.col("lines")).otherwise(F.coalesce("v.n", F.lit(0)))
    every = quoted.select("conv_id", "turn", "passage", "level").distinct()
    passages = every.join(found, ["conv_id", "turn", "passage"], "left").withColumn("lines", F.coalesce("lines", F.lit(0))).join(chosen, ["conv_id", "turn", "passage"], "left").select("conv_id", "turn", "passage", "level", "digest", F.coalesce("sc", "v.sc").alias("source_conv"), F.coalesce("st", "v.st").alias("source_turn"), "lines", matched.alias("matched"))
    passages = durable(passages, "quote-passages")
    direct = passages.where("level = 1 and source_conv is not null").groupBy("conv_id", "turn", "source_conv", "source_turn").agg(F.sum("matched").alias("n")).groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source_conv", "source_turn")).alias("p"))
    nodes = read.where(whole).select("conv_id", "turn").distinct()
    ranged = Ranged(nodes, ("conv_id",), (("turn", False),))
    placed = ranged.scan(ranged.rows, own=False, prev=("max", F.col("turn"))).drop("_part").join(direct, ["conv_id", "turn"], "left")
    placed = durable(placed.select("conv_id", "turn", F.coalesce("p.source_conv", F.when(F.col("prev").isNotNull(), F.col("conv_id"))).alias("pc"), F.coalesce("p.source_turn", "prev").alias("pt"), F.col("p").isNotNull().alias("quotes_parent")), "quote-parents")
    tree = _positions(placed.join(_roots(placed), ["conv_id", "turn"]))
    stats = passages.groupBy("conv_id", "turn").agg(F.max("level").alias("quote_depth"), F.count("*").alias("n_passages"), F.count("source_conv").alias("n_linked"))
    clean = F.btrim(F.array_join(F.transform(F.filter("ls", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), F.lit(" \n\t"))
    rows = read.select("conv_id", "turn", "role", clean.alias("text")).join(tree, ["conv_id", "turn"], "left").join(stats, ["conv_id", "turn"], "left")
    return passages, rows.select(
        "conv_id", "turn", "role", "text", F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("pc").alias("parent_conv"), F.col("pt").alias("parent_turn"), F.coalesce("rc", "conv_id").alias("thread_conv"), F.coalesce("rt", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("position", F.lit(1)).cast("long").alias("position"),
    )


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages in reply order; a thread's first message has the parent (-1, -1)."""
    rows = link(table(spark, sf_dir, "conversations"))[1]
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("parent_conv", "parent_turn")})


QUERIES = {"op1_quote_linking": op1_quote_linking}
LINK_SQL = r"""
with recursive raw as (select row_number() over () rid, conv_id, turn, role, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?m)^[^\n>]*(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*\n+([ \t]*>)', '\1', 'g'), chr(10)) ls from conversations),
tx as (select conv_id, turn, ls, min(rid) tid from raw where conv_id is not null and turn is not null group by all),
ln as (select tid, conv_id, turn, unnest(generate_series(1, len(ls))) pos, unnest(ls) l from tx),
lv as (select *, len(regexp_extract(l, '^[ \t]*(?:>[ \t]*)+')) - len(replace(regexp_extract(l, '^[ \t]*(?:>[ \t]*)+'), '>', '')) lvl, regexp_replace(l, '^[ \t]*(?:>[ \t]*)+', '') body from ln),
nm as (select *, trim(regexp_replace(regexp_replace(lower(body), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g')) norm from lv),
ps as (select *, sum(case when lvl is not distinct from pl then 0 else 1 end) over (partition by tid order by pos rows unbounded preceding) passage from (select *, lag(lvl) over (partition by tid order by pos) pl from nm)),
quoted as (select conv_id, turn, tid, passage, pos, lvl, norm from ps where lvl > 0),
texts as (select conv_id, turn, tid, passage, list(norm order by pos) hs, count(*) lines, max(len(norm)) < 4 short from quoted where norm <> '' group by all),
own as (select conv_id, turn, tid, norm, row_number() over (partition by tid order by pos) i from nm where lvl = 0 and norm <> ''),
al as (select tid, list(norm order by i) a from own group by tid),
runs as (select distinct o.conv_id, o.turn, k.hs from (select distinct hs from texts) k join own o on o.norm = k.hs[1] join al using (tid) where list_slice(a, o.i, o.i + len(k.hs) - 1) = k.hs),
fst as (select hs, min((conv_id, turn)) f, max(conv_id) l from runs group by hs),
near as (select t.tid, t.passage, max(r.turn) n from texts t join runs r on r.hs = t.hs and r.conv_id = t.conv_id and r.turn < t.turn group by all),
exact as (select t.*, case when n is not null then (t.conv_id, n) when f < (t.conv_id, t.turn) and (not short or f[1] = l) then f end s from texts t left join near using (tid, passage) left join fst using (hs)),
votes as (select q.tid, q.passage, q.conv_id, o.conv_id sc, o.turn st, count(*) n from quoted q join exact e on e.tid = q.tid and e.passage = q.passage and s is null join (select distinct conv_id, turn, norm from own) o on o.norm = q.norm and (len(q.norm) >= 4 or o.conv_id = q.conv_id)
  where q.norm <> '' and (o.conv_id, o.turn) < (q.conv_id, q.turn) group by all),
voted as (select tid, passage, (sc, st) s, n from (select *, row_number() over (partition by tid, passage order by n desc, sc = conv_id desc, case when sc = conv_id then -st else sc end, st) k from votes) where k = 1),
chosen as (select q.*, coalesce(e.s, v.s) s, case when e.s is not null then e.lines else v.n end n from (select distinct conv_id, turn, tid, passage, lvl from quoted) q left join exact e on e.tid = q.tid and e.passage = q.passage left join voted v on v.tid = q.tid and v.passage = q.passage),
direct as (select conv_id, turn, (max((n, s)))[2] p from (select conv_id, turn, s, sum(n) n from chosen where lvl = 1 and s is not null group by all) group by all),
node as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) prev from (select distinct conv_id, turn from raw where conv_id is not null and turn is not null)),
par as (select n.conv_id, n.turn, case when p is not null then p[1] when prev is not null then n.conv_id end pc, case when p is not null then p[2] else prev end pt from node n left join direct d on d.conv_id = n.conv_id and d.turn = n.turn),
tree as (select conv_id, turn, conv_id rc, turn rt, 0::bigint depth from par where pc is null union all select p.conv_id, p.turn, rc, rt, depth + 1 from par p join tree t on t.conv_id = p.pc and t.turn = p.pt),
ps2 as (select conv_id, turn, row_number() over (partition by rc, rt order by depth, conv_id, turn) position from tree),
st as (select conv_id, turn, max(lvl) quote_depth, count(*) n_passages, count(s) n_linked from chosen group by all),
clean as (select rid, trim(string_agg(regexp_replace(l, '^[ \t]*(?:>[ \t]*)+', ''), chr(10) order by pos) filter (where not regexp_matches(l, '^[ \t]*>')), ' ' || chr(10) || chr(9)) t from (select rid, unnest(generate_series(1, len(ls))) pos, unnest(ls) l from raw) group by rid)
select r.conv_id, r.turn, r.role, coalesce(t, '') as text, coalesce(quote_depth, 0)::int quote_depth, coalesce(n_passages, 0)::bigint n_passages, coalesce(n_linked, 0)::bigint n_linked, pc parent_conv, pt parent_turn, coalesce(rc, r.conv_id) thread_conv, coalesce(rt, r.turn) thread_turn, coalesce(depth, 0)::bigint depth, coalesce(position, 1)::bigint position
from raw r left join clean using (rid) left join par p on p.conv_id = r.conv_id and p.turn = r.turn left join tree x on x.conv_id = r.conv_id and x.turn = r.turn left join st s on s.conv_id = r.conv_id and s.turn = r.turn left join ps2 y on y.conv_id = r.conv_id and y.turn = r.turn
"""
SQL = {"op1_quote_linking": LINK_SQL.replace("pc parent_conv, pt parent_turn", "coalesce(pc, -1)::bigint parent_conv, coalesce(pt, -1)::bigint parent_turn")}
