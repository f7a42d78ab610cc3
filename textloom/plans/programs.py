"""Registered queries over rendered rows: whole programs (JSON, logs, addresses, documents, dictionaries, motifs), the
term forms, joins, windows and set operations around them. Each comes with SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.charset import CharSet, minterms
from textloom.operators.program import compile_program

from .catalogue import ORACLES, QUERIES, query, stream_folder, table
from .library import PROGRAMS
from .syntax import ProgramError


def _program(name: str, program: str, source: str, key: str, text: str, sql: str, engine: str = "auto", **options) -> None:
    """A query that applies a program to a text which both engines make from a row by the same SQL."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(*key.split(", "), compile_program(program, **options).column(F.expr(text), engine).alias("out"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT {key}, {sql} AS out FROM {source}"


# the forms of terms and regexes

_program(
    "runs_replaced",
    'main := (~/a{7}/ "0" | ~/a{3}/ "1")*',
    "part",
    "p_partkey",
    "repeat('a', p_size)",
    "CASE WHEN p_size NOT IN (1, 2, 4, 5, 8, 11) THEN repeat('0', list_max(list_filter(range(0, p_size // 7 + 1), lambda i: (p_size - 7 * i) % 3 = 0)))"
    " || repeat('1', (p_size - 7 * list_max(list_filter(range(0, p_size // 7 + 1), lambda i: (p_size - 7 * i) % 3 = 0))) // 3) END",
)
_program("plus_terms", 'main := ("<" /[a-z]+/ ">" ~/ /)+', "part", "p_partkey", "concat(p_name, ' ')", r"replace(regexp_replace(p_name, '[a-z]+', '<\0>', 'g'), ' ', '')")
_program("plus_needs_one", 'main := ("<" /[a-z]/ ">")+', "part", "p_partkey", "repeat('x', p_size % 3)", "CASE WHEN p_size % 3 > 0 THEN repeat('<x>', p_size % 3) END")
_program("question_term", 'main := (~/Customer/ "C")? /[#0-9]*/', "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE substr(c_name, 9) END", "CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE '' END || substr(c_name, 9)")
_program("range_terms", 'main := ("[" /[0-9]/ "]"){2,4} /[0-9]*/', "customer", "c_custkey", "substr(c_name, 10, 9 - c_custkey % 9)", r"CASE WHEN c_custkey % 9 < 8 THEN regexp_replace(substr(substr(c_name, 10, 9 - c_custkey % 9), 1, 4), '.', '[\0]', 'g') || substr(substr(c_name, 10, 9 - c_custkey % 9), 5) END")
_program("open_range_terms", 'main := ("[" /[0-9]/ "]"){3,} ~/#/ | /x{,2}/ ~/#/', "part", "p_partkey", "concat(repeat(CASE WHEN p_partkey % 2 = 0 THEN '7' ELSE 'x' END, p_size % 5), '#')", "CASE WHEN p_partkey % 2 = 0 AND p_size % 5 >= 3 THEN repeat('[7]', p_size % 5) WHEN p_partkey % 2 = 1 AND p_size % 5 <= 2 THEN repeat('x', p_size % 5) WHEN p_size % 5 = 0 THEN '' END")
_program("empty_term", 'main := (~/#/ "no. " | 1) /[0-9]+/', "customer", "c_custkey", "substr(c_name, 9 + c_custkey % 2)", "CASE WHEN c_custkey % 2 = 0 THEN 'no. ' ELSE '' END || substr(c_name, 10)")
_program("commented_program", '/* two rules\n   and layout */ main := first // the letters\n  ~/#/ /* gone */ "-" /[0-9]*/ // the rest\nfirst := /[A-Za-z]*/', "customer", "c_custkey", "c_name", "replace(c_name, '#', '-')")
_program("lazy_forms", 'main := a@/0+?/ b@/0??/ c@/0{2,4}?/ d@/0*/ e@/[0-9]*/ !a "," !b "," !c "," !d "," !e', "customer", "c_custkey", "substr(c_name, 10)", r"'0,,00,' || regexp_extract(substr(c_name, 10), '^(0*)', 1)[4:] || ',' || regexp_extract(substr(c_name, 10), '^0*(.*)$', 1)")
_program("lazy_then_any", 'main := /[^ ]*?/ "|" /.*/', "part", "p_partkey", "p_name", "'|' || p_name")
_program("empty_regex", 'main := (/a/ | /()/) "." /.*/', "part", "p_partkey", "p_name", "CASE WHEN starts_with(p_name, 'a') THEN 'a.' || substr(p_name, 2) ELSE '.' || p_name END")
_program("dropped_parts", 'main := ~(/[A-Z]/ "never" /[a-z]+/) /#0*/ /[1-9]?[0-9]*/', "customer", "c_custkey", "c_name", "substr(c_name, 9)")
_program("tail_recursion", 'main := /[a-z]/ main | ~/ / "_" main | 1', "part", "p_partkey", "p_name", "replace(p_name, ' ', '_')")
_program("first_alternative_wins", 'main := (/[a-z]+/ "1" | /[a-z ]+/ "2" | /.*/ "3")', "part", "p_partkey", "p_name", "p_name || CASE WHEN regexp_full_match(p_name, '[a-z]+') THEN '1' WHEN regexp_full_match(p_name, '[a-z ]+') THEN '2' ELSE '3' END")
_program("overwritten_register", 'main := a@/[A-Za-z]+/ ~/#/ a@/[0-9]+/ !a ":" !a', "customer", "c_custkey", "c_name", "substr(c_name, 10) || ':'")
_program("backtrack_quote_words", 'main := ("\\"" /[a-z]+/ "\\"" | /./)*', "part", "p_partkey", "p_name", r"""regexp_replace(p_name, '[a-z]+', '"\0"', 'g')""", engine="backtrack")
_program("backtrack_fields", 'main := "{" /[^,]*/ "}" ~/,/ b@/[^,]*/ ~/,/ "<" /[^,]*/ ">" !b', "customer", "c_custkey", "concat_ws(',', c_custkey, c_name, c_mktsegment)", "'{' || c_custkey || '}<' || c_mktsegment || '>' || c_name", engine="backtrack")
_program("backtrack_choice_at_the_end", 'main := (~/[a-m]/ "l" | ~/[^a-m]/ "h")* ~/[0-4]/ "!" | (~/[a-m]/ "0" | ~/[^a-m]/ "1")*', "customer", "c_custkey", "c_name", r"CASE WHEN regexp_full_match(c_name, '.*[0-4]') THEN replace(regexp_replace(regexp_replace(substr(c_name, 1, length(c_name) - 1), '[^a-m]', 'H', 'g'), '[a-m]', 'l', 'g'), 'H', 'h') || '!' ELSE regexp_replace(regexp_replace(c_name, '[^a-m]', '1', 'g'), '[a-m]', '0', 'g') END", engine="backtrack")

# JSON

_ORDER = "concat('{\"orderkey\": ', o_orderkey, ', \"custkey\": ', o_custkey, ', \"clerk\": {\"id\": ', o_custkey % 7, '}, \"status\": \"', o_orderstatus, '\", \"tags\": [1, 2], \"priority\": \"', o_orderpriority, '\"}')"
_VALUE = 'value := text | /-?[0-9]+/ | object | list\nobject := /\\{"[a-z]*": [0-9]+\\}/\nlist := /\\[[0-9, ]*\\]/\ntext := /"[^"\\n]*"/'
_program(
    "json_objects_to_sql",
    'main := "INSERT INTO o VALUES (" ~/\\{/ field (~/, / field)* ~/\\}/ ");"\nfield := ~/"(orderkey|custkey)": / /[0-9]+/ "," | ~/"status": / text "," | ~/"priority": / text | ~/"[a-z]+": / ~value\n' + _VALUE,
    "orders",
    "o_orderkey",
    _ORDER,
    """'INSERT INTO o VALUES (' || o_orderkey || ',' || o_custkey || ',"' || o_orderstatus || '","' || o_orderpriority || '");'""",
)
_program(
    "json_points_to_sql",
    'main := ~/\\{"type": "Feature", "id": / "(" /[0-9]+/ ~/, "geometry": \\{"type": "Point", "coordinates": \\[/ ", \'POINT(" number ~/, / " " number ~/\\]\\}, "name": / ")\', " text ~/\\}/ ")"\nnumber := /-?[0-9]+/\ntext := ~/"/ "\'" /[^"]*/ ~/"/ "\'"',
    "customer",
    "c_custkey",
    """concat('{"type": "Feature", "id": ', c_custkey, ', "geometry": {"type": "Point", "coordinates": [', c_custkey % 360 - 180, ', ', c_custkey % 180 - 90, ']}, "name": "', c_name, '"}')""",
    "'(' || c_custkey || ', ''POINT(' || (c_custkey % 360 - 180) || ' ' || (c_custkey % 180 - 90) || ')'', ''' || c_name || ''')'",
)
#: Keys that an object may have: the columns of four tables.
_KEYS = [f"{t}_{c}" for t, cs in (("c", "custkey name nationkey acctbal mktsegment phone address"), ("o", "orderkey custkey orderstatus totalprice orderdate orderpriority clerk shippriority"), ("l", "orderkey partkey suppkey linenumber quantity extendedprice discount tax returnflag linestatus shipdate"), ("p", "partkey name brand type size")) for c in cs.split()]
_KNOWN = f'known := /"({"|".join(_KEYS)})"/\n'
_OBJECT = """concat('{"c_custkey": ', c_custkey, ', "c_name": "', c_name, '", ', CASE WHEN c_custkey % 3 = 0 THEN '"c_other": 5, ' ELSE '' END, '"p_size": ', c_custkey % 50, ', "c_mktsegment": "', c_mktsegment, '"}')"""
_program("json_known_keys", 'main := /\\{/ pair (/, / pair)* /\\}/\npair := known /: / value | "\\"unknown\\"" ~/"[a-z_]+"/ /: / value\n' + _KNOWN + _VALUE, "customer", "c_custkey", _OBJECT, f"""replace({_OBJECT}, '"c_other"', '"unknown"')""")
_program("json_known_keys_only", "main := /\\{/ pair (/, / pair)* /\\}/\npair := known /: / value\n" + _KNOWN + _VALUE, "customer", "c_custkey", _OBJECT, f"CASE WHEN c_custkey % 3 <> 0 THEN {_OBJECT} END")
_SELECTED = 'main := ~/\\{/ pair (~/, / pair)* ~/\\}/\npair := "name=" ~/"c_name": / bare ";" | "size=" ~/"p_size": / value ";" | ~known ~/: / ~value'
_BARE = 'bare := ~/"/ /[^"\\n]*/ ~/"/\n'
_program("json_selected_keys", _SELECTED + ' | ~/"[a-z_]+": / ~value "?;"\n' + _BARE + _KNOWN + _VALUE, "customer", "c_custkey", _OBJECT, "'name=' || c_name || ';' || CASE WHEN c_custkey % 3 = 0 THEN '?;' ELSE '' END || 'size=' || c_custkey % 50 || ';'")
_program("json_selected_keys_only", _SELECTED + "\n" + _BARE + _KNOWN + _VALUE, "customer", "c_custkey", _OBJECT, "CASE WHEN c_custkey % 3 <> 0 THEN 'name=' || c_name || ';size=' || c_custkey % 50 || ';' END")
_program("json_record_to_csv", PROGRAMS["json_to_csv"], "customer", "c_custkey", """concat('{"id":"', c_custkey, '","name":"', c_name, '","place":"', c_mktsegment, '"}', chr(10))""", "concat(c_custkey, ',', c_name, ',', c_mktsegment, chr(10))")
_program("csv_record_to_json", PROGRAMS["csv_to_json"], "customer", "c_custkey", "concat(c_custkey, ',', c_name, ',', c_mktsegment, chr(10))", """concat('{"id":"', c_custkey, '","name":"', c_name, '","place":"', c_mktsegment, '"}', chr(10))""")
_program("json_mask_key", PROGRAMS["json_mask_key"], "customer", "c_custkey", """concat('{"n": ', c_custkey, ', "email": "', c_name, '@x.org"}')""", """concat('{"n": ', c_custkey, ', "email": "***"}')""")
_program(
    "timestamp_all_fields",
    'main := "{\\"year\\":" /[0-9]{4}/ ~/-/ ",\\"month\\":" two ~/-/ ",\\"day\\":" two ~/T/ ",\\"hour\\":" two ~/:/ ",\\"minute\\":" two ~/:/ ",\\"second\\":" two ",\\"zone\\":\\"" /Z|[+-][0-9]{2}:[0-9]{2}/ "\\"}"\ntwo := /[0-9]{2}/',
    "events",
    "event_id",
    "concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8), CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '+01:00' END)",
    """strftime(ts, '{"year":%Y,"month":%m,"day":%d,"hour":%H,"minute":%M,"second":%S,"zone":"') || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '+01:00' END || '"}'""",
)

# logs, messages, addresses

_program(
    "access_log",
    PROGRAMS["access_log_to_json"],
    "events",
    "event_id",
    """concat('10.0.0.', user_id % 256, ' - u', user_id, ' [01/Jan/2024:00:00:', event_id % 60, ' +0000] "GET /', event_type, ' HTTP/1.1" ', 200 + event_id % 3, ' ', CASE WHEN event_id % 4 = 0 THEN '-' ELSE '512' END, ' "-" "x"', chr(10))""",
    """concat('[{"host":"10.0.0.', user_id % 256, '","when":"01/Jan/2024:00:00:', event_id % 60, ' +0000","request":"GET /', event_type, ' HTTP/1.1","status":', 200 + event_id % 3, ',"bytes":', CASE WHEN event_id % 4 = 0 THEN '0' ELSE '512' END, '}]', chr(10))""",
)
_program("log_fields", PROGRAMS["log_fields_reordered"], "events", "event_id", "concat('t', event_id, '|', event_type, '|', user_id, '|rest|of it', chr(10))", "concat(user_id, chr(9), event_type, chr(10))")
_program(
    "chat_messages",
    PROGRAMS["chat_message_parts"],
    "conversations",
    "conv_id, turn, role",
    "CASE WHEN turn % 4 = 3 THEN concat('?? ', role, chr(10)) ELSE concat(':', role, ' PRIVMSG c', conv_id, ' t', turn, ' :hello there', chr(13), chr(10)) END",
    "CASE WHEN turn % 4 = 3 THEN concat('bad: ?? ', role, chr(10)) ELSE concat('from ', role, '; command PRIVMSG; c', conv_id, '; t', turn, '; text hello there', chr(10)) END",
)
_program(
    "link_with_login",
    PROGRAMS["link_parts"],
    "customer",
    "c_custkey",
    "concat('https://', CASE WHEN c_custkey % 2 = 0 THEN concat('u', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ':pw' ELSE '' END, '@') ELSE '' END, 'h', c_nationkey, '.example.org', CASE WHEN c_custkey % 3 = 0 THEN ':8080' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '/a/b?q=1' ELSE '' END, chr(10))",
    "concat('scheme https', CASE WHEN c_custkey % 2 = 0 THEN concat('; user u', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '; password pw' ELSE '' END) ELSE '' END, '; host h', c_nationkey, '.example.org', CASE WHEN c_custkey % 3 = 0 THEN '; port 8080' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '; path /a/b?q=1' ELSE '' END, chr(10))",
)
_program("address_list", PROGRAMS["addresses"], "customer", "c_custkey", "concat('c', c_custkey, '@example.org', chr(10), 'no address', chr(10), c_mktsegment, '@', CASE WHEN c_custkey % 2 = 0 THEN 'a.b-c.de' ELSE '-x.de' END, chr(10))", "concat('c', c_custkey, '@example.org', chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, '@a.b-c.de', chr(10)) ELSE '' END)")
_program("address_check", PROGRAMS["address_check"], "customer", "c_custkey", "concat('c', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '@' ELSE '#' END, 'example.org', chr(10))", "CASE WHEN c_custkey % 2 = 0 THEN '' END")
_program("requests_answered", PROGRAMS["web_answer"], "customer", "c_custkey", "concat('GET /', CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'index.html' ELSE 'no' END, ' HTTP/1.1', chr(13), chr(10), 'Host: h', chr(13), chr(10))", "CASE WHEN c_custkey % 3 < 2 THEN concat('HTTP/1.1 200 OK', chr(10), chr(10), 'hello', chr(10)) ELSE concat('HTTP/1.1 404 Not Found', chr(10), chr(10)) END")
_program("faces_drawn", PROGRAMS["greet_if_smiling"], "part", "p_partkey", "concat(p_name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' :-) ' WHEN 2 THEN ' ;-)' ELSE ' :-( :-)' END, p_type)", "concat(CASE WHEN p_size % 4 > 0 THEN 'smiles: ' ELSE '' END, p_name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' ☺ ' WHEN 2 THEN ' 😉' ELSE ' ☹ ☺' END, p_type)")

# documents

_program(
    "sections",
    PROGRAMS["sections_to_json"],
    "customer",
    "c_custkey",
    """concat('; made from a row', chr(10), '[customer ', c_custkey, ']', chr(10), 'name = ', c_name, chr(10), chr(10), 'segment="', c_mktsegment, '"', chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('[more]', chr(10), 'nation=', c_nationkey, chr(10)) ELSE '' END)""",
    """concat('{"customer ', c_custkey, '":{"name":"', c_name, '","segment":"', c_mktsegment, '"}', CASE WHEN c_custkey % 2 = 0 THEN concat(',"more":{"nation":"', c_nationkey, '"}') ELSE '' END, '}', chr(10))""",
)
_program(
    "outline_in_four_stages",
    'start: blocks >> code >> links >> spans\nblocks := (block /\\n/)*\nblock := "<h2>" ~/## / line "</h2>" | "<h1>" ~/# / line "</h1>" | "<ul>" item (~/\\n/ item)* "</ul>" | "<hr/>" ~/-{3,}/ | "<p>" /[^\\n]+/ "</p>" | 1\nitem := "<li>" ~/[*+-] / line "</li>"\nline := /[^\\n]*/\ncode := ("<code>" ~/`/ /[^`\\n]+/ "</code>" ~/`/ | /./)*\nlinks := (~/\\[/ name@/[^\\]\\n]*/ ~/\\]\\(/ "<a href=\\"" /[^)\\n]*/ ~/\\)/ "\\">" !name "</a>" | /./)*\nspans := ("<b>" ~/\\*\\*/ /[^*\\n]+/ "</b>" ~/\\*\\*/ | "<i>" ~/\\*/ /[^*\\n]+/ "</i>" ~/\\*/ | /./)*',
    "customer",
    "c_custkey",
    "concat('# ', c_name, chr(10), '* **', c_mktsegment, '** `x', c_custkey, '`', chr(10), '- see [', c_nationkey, '](/n/', c_nationkey, ')', chr(10), chr(10), 'an *odd* line', chr(10), '---', chr(10))",
    """concat('<h1>', c_name, '</h1>', chr(10), '<ul><li><b>', c_mktsegment, '</b> <code>x', c_custkey, '</code></li><li>see <a href="/n/', c_nationkey, '">', c_nationkey, '</a></li></ul>', chr(10), chr(10), '<p>an <i>odd</i> line</p>', chr(10), '<hr/>', chr(10))""",
)
_program(
    "title_moved_first",
    PROGRAMS["title_first"],
    "customer",
    "c_custkey",
    "concat('@book{k', c_custkey, ',', chr(10), '  author = ', c_name, chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('  tools = x', chr(10)) ELSE '' END, '  title = ', c_mktsegment, chr(10), '  year = 1999', chr(10), '}', chr(10))",
    "concat('@book{k', c_custkey, ',', chr(10), '  title = ', c_mktsegment, chr(10), '  author = ', c_name, chr(10), CASE WHEN c_custkey % 2 = 0 THEN concat('  tools = x', chr(10)) ELSE '' END, '  year = 1999', chr(10), '}', chr(10))",
)
_program(
    "titles_shifted",
    "main := ~title body@/ [^\\n]*\\n/ (title !body body@/ [^\\n]*\\n/)*\ntitle := /title [^\\n]*\\n/",
    "customer",
    "c_custkey",
    "concat('title ', c_custkey, chr(10), ' ', c_name, chr(10), 'title ', c_nationkey, chr(10), ' ', c_mktsegment, chr(10), 'title last', chr(10), ' end', chr(10))",
    "concat('title ', c_nationkey, chr(10), ' ', c_name, chr(10), 'title last', chr(10), ' ', c_mktsegment, chr(10))",
)
_program(
    "notes_rendered",
    'start: mark >> render\nmark := (/<!--/ note@/[^>{}-]*/ /-->/ "{" note_copy "}" | /[^{}]/)*\nnote_copy := !note\nrender := (~/\\{/ "<p>" ("<u>" ~/_/ /[^_{}]+/ ~/_/ "</u>" | /[^_{}]/)* "</p>" ~/\\}/ | /[^{}]/)*',
    "customer",
    "c_custkey",
    "concat('code <!--see _', c_mktsegment, '_ at ', c_custkey, '--> more')",
    "concat('code <!----><p>see <u>', c_mktsegment, '</u> at ', c_custkey, '</p> more')",
)
_program(
    "source_to_latex",
    'start: escape >> tokens\nescape := (~/_/ "\\\\_" | ~/#/ "\\\\#" | /./)*\ntokens := ("\\\\kw{" /if|else|return/ "}" | "\\\\st{" /"[^"\\n]*"/ "}" | "\\\\cm{" /\\/\\/[^\\n]*/ "}" | "\\\\nu{" /[0-9]+/ "}" | /[A-Za-z]+/ | /./)*',
    "customer",
    "c_custkey",
    """concat('if (x_a == "', c_mktsegment, '") return ', c_custkey, '; // ', c_name)""",
    r"""concat('\kw{if} (x\_a == \st{"', c_mktsegment, '"}) \kw{return} \nu{', c_custkey, '}; \cm{// ', replace(c_name, '#', '\#'), '}')""",
)
_program("source_coloured", PROGRAMS["source_colours"], "customer", "c_custkey", """concat('while ', c_nationkey, ' "', c_mktsegment, '" // ', c_name)""", """concat('<k>while</k> <n>', c_nationkey, '</n> <s>"', c_mktsegment, '"</s> <c>// ', c_name, '</c>')""")
_program("images_rewritten", 'main := (~/!\\[/ alt@/[^\\]\\n]*/ ~/\\]\\(/ "<img src=\\"" /[^)\\n]*/ ~/\\)/ "\\" alt=\\"" !alt "\\"/>" | "<tt>" ~/`/ /[^`\\n]*/ ~/`/ "</tt>" | /./)*', "customer", "c_custkey", "concat('see ![', c_mktsegment, '](/i/', c_custkey, '.png) and `', c_name, '` now')", """concat('see <img src="/i/', c_custkey, '.png" alt="', c_mktsegment, '"/> and <tt>', c_name, '</tt> now')""")
_program("time_of_a_line", "main := ~/[^:\\n]*: */ /[0-9]+/ ~/ ms[^\\n]*/", "customer", "c_custkey", "concat(c_mktsegment, ' took: ', c_custkey * 3, ' ms in all')", "CAST(c_custkey * 3 AS VARCHAR)")
_program("element_replaced", 'main := (~/<dep>[^<]*<\\/dep>/ "<dep>local</dep>" | /./)*', "customer", "c_custkey", "concat('<a><dep>', c_name, '</dep></a><dep>', c_custkey, '</dep>')", "'<a><dep>local</dep></a><dep>local</dep>'")
_program("block_replaced", 'main := /[^\\[]*/ /\\[begin\\]\\n/ "new" ~/[^\\[]*/ /\\n\\[end\\]/ /.*/', "customer", "c_custkey", "concat(c_name, chr(10), '[begin]', chr(10), c_mktsegment, chr(10), c_custkey, chr(10), '[end] tail')", "concat(c_name, chr(10), '[begin]', chr(10), 'new', chr(10), '[end] tail')")
_program("string_literals", PROGRAMS["string_literals"], "customer", "c_custkey", """concat('f("', c_name, '", "', c_mktsegment, '")')""", "concat(c_name, chr(10), c_mktsegment, chr(10))")

# motifs and dictionaries

_MOTIFS = ["acgt", "tt[ac]g", "gg[^a]c", "c{4}", "a[cg]a[cg]a", "tgt[at]", "cag|gac", "ttta", "gcgc"]
_DNA = "concat(" + ", ".join(f"translate(md5(concat(p_name, '{k}')), '0123456789abcdef', 'acgtacgtacgtacgt')" for k in range(6)) + ")"
_NAMES = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{m}') THEN '{k}'" for k, m in enumerate(_MOTIFS, 1)) + " END"
_program("nine_motifs", "main := (" + " | ".join(f'~/{m}/ "{k}"' for k, m in enumerate(_MOTIFS, 1)) + " | ~/./)*", "part", "p_partkey", _DNA, f"array_to_string(list_transform(regexp_extract_all({_DNA}, '{'|'.join(f'(?:{m})' for m in _MOTIFS)}'), lambda m: {_NAMES}), '')")
_program(
    "motifs_counted_in_stages",
    'start: upper >> first >> second >> rest\nupper := (~/acgt/ "1" | /./)*\nfirst := (~/tt[ac]g/ "2" | /./)*\nsecond := (~/gg[^a]c/ "3" | /./)*\nrest := (/[0-9]/ | ~/./)*',
    "part",
    "p_partkey",
    _DNA,
    f"regexp_replace(regexp_replace(regexp_replace(replace({_DNA}, 'acgt', '1'), 'tt[ac]g', '2', 'g'), 'gg[^a]c', '3', 'g'), '[^0-9]', '', 'g')",
)


def _words(spark, sf_dir):
    """The words of the parts' names, and a dictionary of some of them as a table."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ", -1)).alias("pos", "w"))
    known = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("w")).distinct().filter("w < 'n'")
    return parts, known.select("w", F.upper("w").alias("v"))


_WORDS_SQL = "t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part), d AS (SELECT DISTINCT w, upper(w) AS v FROM t WHERE w < 'n')"


@query(f"WITH {_WORDS_SQL} SELECT p_partkey, string_agg(coalesce(v, t.w), ' ' ORDER BY pos) AS out FROM t LEFT JOIN d ON t.w = d.w GROUP BY p_partkey")
def dictionary_join(spark, sf_dir):
    """A dictionary that is a table: an outer join on the words, whose side Spark broadcasts while its size allows it."""
    parts, known = _words(spark, sf_dir)
    joined = parts.join(known, "w", "left").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("v", "w").alias("v")))).alias("words"))
    return joined.select("p_partkey", F.array_join(F.transform("words", lambda x: x["v"]), " ").alias("out"))


@query(f"WITH {_WORDS_SQL} SELECT DISTINCT p_partkey FROM t WHERE w IN (SELECT w FROM d)")
def dictionary_semi_join(spark, sf_dir):
    parts, known = _words(spark, sf_dir)
    return parts.join(known, "w", "left_semi").select("p_partkey").distinct()


@query(f"WITH {_WORDS_SQL} SELECT p_partkey, w, pos::INTEGER - 1 AS pos FROM t WHERE w NOT IN (SELECT w FROM d)")
def dictionary_anti_join(spark, sf_dir):
    parts, known = _words(spark, sf_dir)
    return parts.join(known, "w", "left_anti").select("p_partkey", "w", F.col("pos").cast("int").alias("pos"))


_LCS_STEP = "list_transform(range(1, 8), lambda j: greatest(r.row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda i: 'ECONOMY'[i] = r.s[r.pos + 1]), lambda i: (CASE WHEN i = 1 THEN 0 ELSE r.row[i - 1] END) + 1)), 0)))"


@query(
    "WITH RECURSIVE r(p_partkey, s, pos, row) AS (SELECT p_partkey, p_type, 0::BIGINT, [0, 0, 0, 0, 0, 0, 0]::BIGINT[] FROM part UNION ALL "
    f"SELECT p_partkey, s, pos + 1, {_LCS_STEP} FROM r WHERE pos < length(s)) "
    "SELECT p_partkey, length(s) + 7 - 2 * row[7] <= 7 AS near FROM r WHERE pos = length(s)"
)
def approx_lcs(spark, sf_dir):
    """The default metric counts insertions and deletions."""
    return table(spark, sf_dir, "part").select("p_partkey", compile_program("main := /ECONOMY/<7>").accepts("p_type").alias("near"))


@query("SELECT p_partkey, CASE WHEN levenshtein(p_type, 'ECONOMY') <= 4 THEN 'ECONOMY' END AS lev, CASE WHEN length(p_type) = 7 AND (CASE WHEN length(p_type) = 7 THEN hamming(p_type, 'ECONOMY') ELSE 9 END) <= 4 THEN p_type END AS ham FROM part")
def approx_trailing_edits(spark, sf_dir):
    """Edits after the pattern's end: allowed by insertions and deletions, not by substitutions."""
    text = F.col("p_type")
    lev = compile_program("main := /ECONOMY/<4>", metric="levenshtein").column(text, "kernel")
    ham = compile_program("main := /ECONOMY/<4>", metric="hamming", mode="matching").column(text, "kernel")
    return table(spark, sf_dir, "part").select("p_partkey", lev.alias("lev"), ham.alias("ham"))


# faults, symbols, codes

_FAULTY = ["main := other", "main := /a/\nmain := /b/", "main := main /a/ | 1", "main := (/a/<1>)<1>", "main := /[a/", "main := /a/", 'main := /a/ main | "x"', "start: one >> two\none := /a/"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {good})" for k, good in enumerate(["false", "false", "false", "false", "false", "true", "true", "false"])) + ") AS t(program, good)")
def program_faults(spark, sf_dir):
    """Which of some programs are well formed; the check is part of compiling, on the driver."""
    rows = []
    for k, text in enumerate(_FAULTY):
        try:
            compile_program(text)
            rows.append((k, True))
        except ProgramError:
            rows.append((k, False))
    return spark.createDataFrame(rows, "program int, good boolean")


@query("SELECT * FROM (VALUES (97, 103, 1), (104, 109, 3), (110, 122, 2), (48, 57, 4)) AS t(low, high, classes)")
def symbol_classes(spark, sf_dir):
    """The coarsest classes that some sets tell apart, and (as bits) the sets that each is in; the class in no set is left out."""
    sets = [CharSet.of([(97, 109)]), CharSet.of([(104, 122)]), CharSet.of([(48, 57)])]
    rows = [(a, b, sum(1 << k for k, s in enumerate(sets) if CharSet(((a, b),)) <= s)) for part in minterms(sets) for a, b in part.ranges]
    return spark.createDataFrame([r for r in rows if r[2]], "low int, high int, classes int")


@query("SELECT c_custkey, array_to_string(list_transform(string_split(substr(c_name, 10), ''), lambda d: lpad(bin(d::INTEGER), 4, '0')), '') AS bits, substr(c_name, 10) AS digits FROM customer")
def codes_of_fixed_width(spark, sf_dir):
    """The ranks of the symbols read as words of four bits, and decoded again."""
    codes = compile_program("main := /[0-9]{9}/").codes(F.expr("substr(c_name, 10)"))
    bits = F.array_join(F.transform(codes, lambda c: F.lpad(F.bin(c.cast("long")), 4, "0")), "")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.conv(F.substring("bits", k * 4 + 1, F.lit(4)), 2, 10)), "")
    return table(spark, sf_dir, "customer").select("c_custkey", bits.alias("bits")).select("c_custkey", "bits", digits.alias("digits"))


# sets, order, aggregates and windows around programs

_STEM = 'main := /[a-z]+/ ~/ .*/ | /[a-z]+/'


@query("SELECT DISTINCT regexp_extract(p_name, '^[a-z]+') AS w FROM part WHERE p_size < 20 UNION SELECT lower(p_type) FROM part")
def outputs_united(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.filter("p_size < 20").select(compile_program(_STEM).column("p_name").alias("w")).union(part.select(F.lower("p_type"))).distinct()


@query("SELECT regexp_extract(p_name, '^[a-z]+') AS w FROM part WHERE p_size < 3 INTERSECT SELECT regexp_extract(p_name, '^[a-z]+') FROM part WHERE p_size > 48")
def outputs_in_both(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", compile_program(_STEM).column("p_name").alias("w"))
    return part.filter("p_size < 3").select("w").intersect(part.filter("p_size > 48").select("w"))


@query("SELECT regexp_extract(p_name, '^[a-z]+') AS w FROM part WHERE p_partkey % 40 = 0 EXCEPT SELECT regexp_extract(p_name, '^[a-z]+') FROM part WHERE p_partkey % 40 = 1")
def outputs_in_one_only(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", compile_program(_STEM).column("p_name").alias("w"))
    return part.filter("p_partkey % 40 = 0").select("w").subtract(part.filter("p_partkey % 40 = 1").select("w"))


@query(r"""SELECT p_partkey, replace(regexp_replace(p_name, '[a-z]+', '<\0>', 'g'), ' ', '') AS out FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 20""")
def longest_outputs(spark, sf_dir):
    """The 20 longest names, rendered."""
    rows = table(spark, sf_dir, "part").orderBy(F.char_length("p_name").desc(), "p_partkey").limit(20)
    return rows.select("p_partkey", compile_program('main := ("<" /[a-z]+/ ">" ~/ ?/)+').column("p_name").alias("out"))


@query("SELECT c_nationkey, string_agg(upper(c_mktsegment[1]) || substr(c_name, 10), ',' ORDER BY c_custkey) AS out FROM customer GROUP BY c_nationkey")
def outputs_aggregated(spark, sf_dir):
    """Outputs of a program joined in order for each group."""
    text = F.concat_ws("|", "c_mktsegment", "c_name")
    out = compile_program("main := /[A-Z]/ ~/[^|]*\\|[^#]*#/ /[0-9]*/").column(text)
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", out.alias("out")))).alias("x"))
    return rows.select("c_nationkey", F.array_join(F.transform("x", lambda r: r["out"]), ",").alias("out"))


def _parsed(spark, sf_dir):
    """Events whose field a program parses, with the field as a number."""
    k = compile_program('main := ~/\\{"k": / /[0-9]+/ ~/\\}/').column("props").cast("long")
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), k.alias("k")).filter("k is not null")


@query("SELECT event_type, start, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    """Windows of an hour every half hour over parsed fields."""
    rows = _parsed(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '10 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_windows(spark, sf_dir):
    """Sessions of parsed events that are less than ten minutes apart."""
    rows = _parsed(spark, sf_dir).groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    """A stream of events, their field parsed, in hourly windows that the watermark (ten minutes) has closed."""
    where = stream_folder(spark)
    program = compile_program('main := ~/\\{"k": / /[0-9]+/ ~/\\}/')
    # a run over what is there: one batch of rows, then one that the watermark of the first allows to end
    source = table(spark, sf_dir, "events").select("event_type", "ts", "props")
    source.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "props").coalesce(1).write.parquet(f"{where}/in")
    rows = spark.readStream.schema("event_type string, ts timestamp, props string").parquet(f"{where}/in").filter(program.accepts("props"))
    counts = rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = counts.select("event_type", F.col("w.start").alias("start"), "n")
    run = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))
