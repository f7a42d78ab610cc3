"""The ready programs on small inputs, with both parsers and as columns."""

import pytest

from textloom.plans.library import PROGRAMS, get

CASES = [
    ("identity", "a\nb", "a\nb"),
    ("letters_in_order", "abba\n", "aabb\n"),
    ("swap_first_lines", "x\ny\n", "y\nx\n"),
    ("reverse_list", "a;b;c;\n", "c;b;a;\n"),
    ("keep_lines_ending_in_b", "ab\nba\nb\n", "ab\n\nb\n"),
    ("number_groups", "1234567\n12\n123\n", "1,234,567\n12\n123\n"),
    ("greet_if_smiling", "hi :-) you", "smiles: hi ☺ you"),
    ("greet_if_smiling", "hi you", "hi you"),
    ("csv_second_column", "a,b,c\nd,e\n", "b\ne\n"),
    ("csv_to_json", "1,Ann,Rome\n", '{"id":"1","name":"Ann","place":"Rome"}\n'),
    ("json_to_csv", '{"id":"1","name":"Ann","place":"Rome"}\n', "1,Ann,Rome\n"),
    ("json_object_to_sql", '{"a": "x\\"y", "b": -1.5}\n{"a": null, "b": true}\n', 'INSERT INTO t VALUES\n("x\\"y",-1.5),(NULL,true);\n'),
    ("json_mask_key", '{"n": 1, "email": "a@b"}', '{"n": 1, "email": "***"}'),
    ("json_keep_known_keys", '{"id":1,"x":"q","name":"n"}\n{}\n', '{"id":1,"unknown":0,"name":"n"}\n{}\n'),
    ("timestamp_to_json", "2020-01-02T03:04:05+01:00\n", '{"date":"2020-01-02","time":"03:04:05","zone":"+01:00"}\n'),
    ("access_log_to_json", '1.2.3.4 - u [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 - "r" "a"\n', '[{"host":"1.2.3.4","when":"10/Oct/2000:13:55:36 -0700","request":"GET /a HTTP/1.0","status":200,"bytes":0}]\n'),
    ("access_log_to_json", "", "[]\n"),
    ("chat_message_parts", ":srv 001 me :Hello there\r\nPING a b\r\n??\r\n", "from srv; command 001; me; text Hello there\ncommand PING; a; b\nbad: ??\n"),
    ("log_fields_reordered", "t|a|b|z\n", "b\ta\n"),
    ("web_answer", "GET / HTTP/1.1\r\nHost: x\r\n", "HTTP/1.1 200 OK\n\nhello\n"),
    ("web_answer", "GET /no HTTP/1.1\r\n", "HTTP/1.1 404 Not Found\n\n"),
    ("addresses", "a.b@c.de\nno at\n@x.y\nz@w\n", "a.b@c.de\n"),
    ("address_check", "a@b.c\n", ""),
    ("address_check", "a@b\n", None),
    ("link_parts", "http://u:p@h.x:80/a?b\nftp://h\n", "scheme http; user u; password p; host h.x; port 80; path /a?b\nscheme ftp; host h\n"),
    ("sections_to_json", '; note\n[one]\nk = a "b\n\n[two]\nx="y"\nz=\n', '{"one":{"k":"a \\"b"},"two":{"x":"y","z":""}}\n'),
    ("outline_to_html", "# T\n* a\n* **b** `c`\n\ntext [n](u)\n---\n", '<h1>T</h1>\n<ul><li>a</li><li><b>b</b> <code>c</code></li></ul>\n\n<p>text <a href="u">n</a></p>\n<hr/>\n'),
    ("tags_only", "<a>x<b/>", "<a><b/>"),
    ("without_comment_lines", "// a\nb // c\n//\n", "b // c\n"),
    ("quoted_words", "ab 1 c", '"ab" 1 "c"'),
    ("title_first", "@book{k,\n  author = a\n  title = t\n  year = y\n}\n\n", "@book{k,\n  title = t\n  author = a\n  year = y\n}\n\n"),
    ("source_colours", 'if x1 "s" // c', '<k>if</k> x<n>1</n> <s>"s"</s> <c>// c</c>'),
    ("string_literals", 'f("a", "b")', "a\nb\n"),
    ("form_target", '<form action="/x">', '<form action="/proxy?to=/x">'),
    ("motif_names", "xxagggtaaaycgggtaaa", "A B "),
    ("words_translated", "the red house here", "la rossa casa here"),
]


@pytest.mark.parametrize("name,text,expected", CASES)
def test_program(name, text, expected):
    p = get(name)
    assert p.run(text).value == expected
    assert p.run(text, "backtrack").value == expected


def test_all_are_covered():
    assert {c[0] for c in CASES} == set(PROGRAMS)


def test_columns(spark):
    for name in PROGRAMS:
        rows = [(t, e) for n, t, e in CASES if n == name]
        df = spark.createDataFrame(rows, "s string, e string").coalesce(1)
        assert [r[0] for r in df.select(get(name).column("s")).collect()] == [e for _, e in rows], name


def test_command_line(tmp_path, monkeypatch, capsys):
    import io

    from textloom.__main__ import main

    (tmp_path / "p.loom").write_text('main := ("<" /[0-9]+/ ">" | /[^!]/)*')
    for text, code, out, err in (("a12", 0, "a<12>", ""), ("a!", 1, "", "rejected at symbol 1\n")):
        for engine in ("kernel", "backtrack"):
            monkeypatch.setattr("sys.stdin", io.StringIO(text))
            assert main(["run", str(tmp_path / "p.loom"), "--engine", engine]) == code
            assert tuple(capsys.readouterr()) == (out, err)
    assert main(["explain", str(tmp_path / "p.loom")]) == 0 and "main: " in capsys.readouterr().out
    assert main(["dot", str(tmp_path / "p.loom"), "--time"]) == 0
    drawn = capsys.readouterr()
    assert drawn.out.startswith("digraph") and "compile: " in drawn.err
