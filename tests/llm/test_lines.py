from quillon.llm import lines

SCHEMA = "doc_id long, text string, pos string"


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    return {(r.doc_id, r.pos): r.text for r in lines.without_boilerplate(docs).collect()}


def test_recurring_templates_go(spark):
    rows = [(d, f"own line {'abcdefgh'[d]} goes first\nUser {d} logged in from host {d * 7}\nanother own text {'abcdefgh'[d]}") for d in range(8)]
    got = kept(spark, rows)
    assert all("logged in" not in t and t.count("\n") == 1 for t in got.values())


def test_variable_fields_are_found_in_a_leaf(spark):
    names = ["alice", "bob", "carol", "dave", "erin", "frank"]
    rows = [(d, f"{n} {n} {n}\nlogin from user {n} was accepted today\n{n} {n} end {n}") for d, n in enumerate(names)]
    assert all("login" not in t for t in kept(spark, rows).values())


def test_copies_and_prose_stay(spark):
    text = "the first line of a text\nthe second line of it\nand a third one follows"
    rows = [(d, text) for d in range(9)] + [(20, "a line of its own here\nx y z")]
    assert kept(spark, rows) == {(d, "x"): t for d, t in rows}


def test_edge_cases(spark):
    rows = [(None, None), (1, None), (2, ""), (2, ""), (3, "\n\n"), (None, "a\r\nb"), (4, "z " * 30_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, lines.line_dedup(docs).select("doc_id", "n_lines", "n_dropped").collect()), key=repr)
    assert got == sorted([(None, 0, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0), (3, 3, 0), (None, 2, 0), (4, 1, 0)], key=repr)
    assert lines.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def words(d, n, seed):
    return " ".join(f"{'abcdefghij'[d % 10]}{'klmnopqrst'[d // 10]}{'abcdefghij'[(k * 7 + seed) % 10]}{'abcdefghij'[k // 10]}" for k in range(n))


def test_templates_go_wherever_they_stand(spark):
    """At a text's edge, between blank lines and in a block, but not with copies."""
    block = "all rights are reserved here\nreleased under the usual licence\nwithout a warranty of any kind"
    rows = [(d, f"the header of our site\n{words(d, 30, 1)}\n\nplease share this page\n\n{words(d, 30, 2)}\n{block}") for d in range(8)]
    story = [words(50, 12, k) for k in range(12)]  # eight near copies of one document, one line of each edited
    for d in range(8):
        rows.append((20 + d, "\n".join([*story[:d], words(60 + d, 12, 3), *story[d + 1 :]])))
    got = kept(spark, rows)
    for d, text in rows:
        want = text if d >= 20 else f"{words(d, 30, 1)}\n\n\n{words(d, 30, 2)}"
        assert got[d, "x"] == want


def test_long_lines_and_leaves_with_strangers_have_variable_fields(spark):
    names = ["alice", "bob", "carol", "dave", "erin", "frank"]
    fixed = words(7, 60, 4)
    rows = [(d, f"{words(d, 30, 1)}\nlogin from user {n} was accepted today\n{words(d, 30, 2)}\nall pages of {n} {fixed}\n{words(d, 30, 3)}") for d, n in enumerate(names)]
    rows.append((9, f"{words(9, 30, 1)}\nlogin from user some other words stand\n{words(9, 30, 2)}"))
    got = kept(spark, rows)
    assert all(got[d, "x"] == "\n".join(words(d, 30, k) for k in (1, 2, 3)) for d in range(6))
    assert got[9, "x"] == rows[-1][1]


def test_query_agrees_with_its_sql(spark):
    """Footers, variable fields, strangers in a leaf, copies, repeated rows and nulls, in Spark and in DuckDB."""
    import duckdb

    block = "all rights are reserved here\nreleased under the usual licence"
    rows = [(d, f"{words(d, 30, 1)}\nlogin from user name{'abcdefgh'[d]} was accepted today\n\tthe  page {d} of 9\r\n{words(d, 9, 2)}\n{block}") for d in range(8)]
    rows += [(20 + d, "\n".join([words(50, 12, 1), words(50, 12, 2), words(50, 12, 4), words(60 + d, 5, 3)])) for d in range(7)]
    rows += [(9, f"{words(9, 30, 1)}\nlogin from user some other words stand"), (9, rows[0][1]), (None, None), (40, ""), (41, "\n\n")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, lines.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert got == sorted(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({lines.SQL})").fetchall(), key=repr)
    assert sum(r[2] for r in got) == 9 * 4
