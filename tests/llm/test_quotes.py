import random

import duckdb

from tessera.llm import quotes

A = "First message here\nwith a second line\nThanks a lot"
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", "On Monday, Ann wrote:\n> First message here\n> with a second  LINE\nMy answer is long enough"),
    (1, 2, "user", "Interlude of some sort"),
    (1, 3, "user", "> > First message here\n> My answer is long, enough!\nSo be it, then"),
    (1, 4, "user", ">First message here\n\nBack to the start"),
    (2, 0, "user", "> Interlude of some sort\nQuoting another conversation"),
    (2, 1, "assistant", "no quotes\nThanks a lot"),
    (2, 2, "user", "> Thanks a lot\nwelcome to you"),
    (0, 0, "user", "> nothing knows this line\nfresh start"),
    (3, 0, "user", None),
    (3, 5, "user", ""),
    (None, 1, "user", "> First message here\nlost"),
    (1, 2, "user", "Interlude of some sort"),
]


def test_links_threads_and_clean_texts(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, depth int")
    passages, rows = quotes.link(docs)
    got = [(r.conv_id, r.turn, r.text, r.quote_depth, r.n_linked, (r.parent_conv, r.parent_turn), (r.thread_conv, r.thread_turn), r.depth) for r in rows.collect()]
    none = (None, None)
    want = [
        (1, 0, A, 0, 0, none, (1, 0), 0),
        (1, 1, "My answer is long enough", 1, 1, (1, 0), (1, 0), 1),
        (1, 2, "Interlude of some sort", 0, 0, (1, 1), (1, 0), 2),
        (1, 2, "Interlude of some sort", 0, 0, (1, 1), (1, 0), 2),
        (1, 3, "So be it, then", 2, 2, (1, 1), (1, 0), 2),
        (1, 4, "Back to the start", 1, 1, (1, 0), (1, 0), 1),
        (2, 0, "Quoting another conversation", 1, 1, (1, 2), (1, 0), 3),
        (2, 1, "no quotes\nThanks a lot", 0, 0, (2, 0), (1, 0), 4),
        (2, 2, "welcome to you", 1, 1, (2, 1), (1, 0), 5),
        (0, 0, "fresh start", 1, 0, none, (0, 0), 0),
        (3, 0, "", 0, 0, none, (3, 0), 0),
        (3, 5, "", 0, 0, (3, 0), (3, 0), 1),
        (None, 1, "lost", 0, 0, none, (None, 1), 0),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    nested = [p for p in passages.collect() if (p.conv_id, p.turn) == (1, 3)]
    assert sorted((p.level, p.source_turn, p.lines, p.matched) for p in nested) == [(1, 1, 1, 1), (2, 0, 1, 1)]


def test_long_chain_and_empty(spark):
    chain = spark.range(300).selectExpr("7L conv_id", "id turn", "'user' role", "concat('text number ', id) text")
    rows = {r.turn: (r.thread_turn, r.depth) for r in quotes.link(chain)[1].collect()}
    assert rows == {k: (0, k) for k in range(300)}
    assert quotes.link(chain.limit(0))[1].count() == 0


def test_rows_equal_the_sql_on_quoted_conversations(spark, tmp_path):
    """Made conversations in which messages quote earlier ones whole, nested and in part, with attributions and answers between."""
    rng, rows = random.Random(12), []
    for conv in range(25):
        said, turns = [], rng.randrange(1, 9)
        for turn in range(turns):
            own = [f"conversation {conv} message {turn} line {k} {rng.choice(['alpha', 'beta', 'gamma'])}" for k in range(rng.randrange(1, 5))]
            text = list(own)
            if said and rng.random() < 0.75:
                at = rng.randrange(len(said))
                lo = rng.randrange(len(said[at]))
                part = said[at][lo : lo + rng.randrange(1, 4)]
                quote = ["> " + x.upper().replace(" line", ",  line") for x in part]
                if rng.random() < 0.4 and at:
                    quote = ["> > " + x for x in said[rng.randrange(at)][:2]] + quote
                text = ([f"On day {turn}, someone wrote:"] if rng.random() < 0.5 else []) + quote + own
            said.append(own)
            rows.append((conv, turn * 2, rng.choice(["user", "assistant"]), "\n".join(text)))
    rows += [(90, 0, "user", None), (90, 3, "user", "")]
    assert same_as_sql(spark, tmp_path, rows) > 40


def same_as_sql(spark, tmp_path, rows):
    """How many messages have linked passages, after the query's rows were found equal to the SQL's."""
    at = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(at / "conversations.parquet"))
    got = quotes.op1_quote_linking(spark, str(at))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{at}/conversations.parquet/*.parquet'")
    want = con.execute(quotes.SQL["op1_quote_linking"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda xs, order: sorted(str([x[order.index(c)] for c in sorted(order)]) for x in xs)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)
    return got.where("n_linked > 0").count()


def test_rows_equal_the_sql_where_lines_repeat(spark, tmp_path):
    """Openings that several messages share, short lines, lines of many messages, repeated rows, and passages of other conversations."""
    common = ["Yes", "ok", "no", "the same opening line", "another line that many write", "a third one", ":-)", "Yes"]
    for seed in range(2):
        rng, rows = random.Random(seed), []
        for conv in range(14):
            said = []
            for turn in range(rng.randrange(1, 7)):
                own = [rng.choice(common) if rng.random() < 0.7 else f"only here {conv} {turn} {k}" for k in range(rng.randrange(1, 5))]
                quote = []
                for level in (1, 2, 1)[: rng.randrange(4)]:
                    lines = rng.choice(said) if said and rng.random() < 0.6 else [rng.choice(common) for _ in range(rng.randrange(1, 4))]
                    quote += ["> " * level + x for x in lines[rng.randrange(2) :]] + rng.choice(([], ["between"]))
                said.append(own)
                rows.append((conv, turn, "user", "\n".join(quote + own)))
        rows += [rows[3], (rows[5][0], rows[5][1], "user", "> Yes\na second text"), (None, 1, "user", "> Yes"), (2, None, "user", "> ok")]
        assert same_as_sql(spark, tmp_path, rows) > 15


def test_the_sql_links_the_whole_passage_and_short_lines(spark, tmp_path):
    lines = [f"L{k} of the text" for k in range(1, 6)]
    said = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join(lines[:3])), (1, 2, "user", "\n".join(f"> {x}" for x in lines)), (2, 0, "user", "Yes"), (2, 1, "user", "well"), (2, 2, "user", "> Yes")]
    assert same_as_sql(spark, tmp_path, said) == 2
    long = "word " * 50_000
    assert same_as_sql(spark, tmp_path, [(1, 0, "user", long), (1, 1, "user", f"> {long}\nso long"), (1, 2, "user", "> > " * 2000 + "x")]) == 1


def test_positions_follow_the_reply_order(spark):
    docs = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, depth int")
    rows = {(r.conv_id, r.turn): r for r in quotes.link(docs)[1].collect()}
    threads = {}
    for r in rows.values():
        threads.setdefault((r.thread_conv, r.thread_turn), []).append((r.depth, r.conv_id, r.turn, r.position))
        parent = rows.get((r.parent_conv, r.parent_turn))
        assert parent is None or parent.position < r.position
    for members in threads.values():
        if members[0][1] is not None:
            assert [m[3] for m in sorted(members)] == list(range(1, len(members) + 1))


def sources(spark, rows):
    got = quotes.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))[0].collect()
    return {(p.conv_id, p.turn): ((p.source_conv, p.source_turn), p.lines, p.matched) for p in got}


FIVE = [f"line number {k} of the text" for k in range(5)]
QUOTE = "\n".join(f"> {x}" for x in FIVE)


def test_a_passage_goes_to_the_message_that_has_all_of_it(spark):
    rows = [(1, 0, "\n".join(FIVE)), (1, 1, "\n".join(FIVE[:3])), (1, 2, QUOTE), (1, 3, "\n\n".join(FIVE[::-1])), (1, 4, QUOTE.replace(" number 0", "")), (0, 9, "\n".join(FIVE)), (2, 0, QUOTE)]
    assert sources(spark, rows) == {(1, 2): ((1, 0), 5, 5), (1, 4): ((1, 3), 5, 4), (2, 0): ((0, 9), 5, 5)}


def test_votes_over_rare_and_frequent_lines(spark, monkeypatch):
    rows = [(1, 0, "\n".join(FIVE[:4]) + "\nother")] + [(1, k, FIVE[3]) for k in range(1, 6)] + [(1, k, FIVE[4] + "\n" + FIVE[2]) for k in range(6, 9)]
    rows += [(1, 9, QUOTE), (1, 10, f"> {FIVE[4]}\n> {FIVE[3]}\n> nowhere at all"), (3, 0, QUOTE)]
    want = {(1, 9): ((1, 0), 5, 4), (1, 10): ((1, 8), 3, 1), (3, 0): ((1, 0), 5, 4)}
    for rare in (64, 2, 0):
        monkeypatch.setattr(quotes, "RARE", rare)
        assert sources(spark, rows) == want


def test_short_lines_form_passages_and_link(spark):
    rows = [(1, 0, "Yes"), (1, 1, "well then"), (1, 2, "> Yes\nfine"), (1, 3, "好的吗"), (1, 4, "so"), (1, 5, "> > Yes\n> 好的吗"), (1, 6, "> :-)\nglad"), (2, 0, "> Yes"), (2, 1, "ok"), (3, 0, "> ok"), (4, 0, "ok"), (5, 0, "> so\n> never written before"), (5, 1, "> so")]
    docs = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.quote_depth, r.n_passages, r.n_linked, (r.parent_conv, r.parent_turn)) for r in quotes.link(docs)[1].collect()}
    none = (None, None)
    assert got[1, 2] == (1, 1, 1, (1, 0)) and got[1, 5] == (2, 2, 2, (1, 3)) and got[1, 6] == (1, 1, 0, (1, 5))
    assert got[2, 0] == (1, 1, 1, (1, 0)) and got[3, 0] == (1, 1, 0, none) and got[5, 0] == (1, 1, 0, none) and got[5, 1] == (1, 1, 1, (1, 4))
