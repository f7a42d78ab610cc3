"""Ready programs: conversions of common text formats, written in the rule language.

`PROGRAMS` maps a name to program text; `get(name)` compiles one. Line-based programs take
texts in which every line is closed by a newline.
"""

from __future__ import annotations

from textloom.operators.program import Program, compile_program

_JSON_TEXT = r"""jtext := /"([^"\\\n]|\\[^\n])*"/
"""

PROGRAMS: dict[str, str] = {
    # copying, swapping and choosing
    "identity": "main := /./*",
    "letters_in_order": 'main := (~/a/ [first += "a"] | ~/b/ [second += "b"])* ~/\\n/ !first !second "\\n"',
    "swap_first_lines": "main := one@line !one\nline := two@/[^\\n]*\\n/ /[^\\n]*\\n/ !two",
    "reverse_list": "main := (entry@/[^;\\n]*;/ [done <- entry done])* !done /\\n/",
    "keep_lines_ending_in_b": 'main := (row /\\n/)*\nrow := /[ab]*b/ | ~/[ab]*/',
    "number_groups": 'main := (number /\\n/)*\nnumber := /[0-9]{1,3}/ ("," /[0-9]{3}/)*',
    "greet_if_smiling": 'start: find >> draw\nfind := "smiles: " any | none\nany := none (/:-\\)|;-\\)|:-\\(/) /.*/\nnone := /./*?\ndraw := (~/:-\\)/ "☺" | ~/;-\\)/ "😉" | ~/:-\\(/ "☹" | /./)*',
    # delimited text
    "csv_second_column": 'main := (~cell ~/,/ cell ~(/,/ cell)* /\\n/)*\ncell := /[^,\\n]*/',
    "csv_to_json": 'main := (record /\\n/)*\nrecord := "{\\"id\\":\\"" cell "\\",\\"name\\":\\"" next "\\",\\"place\\":\\"" next "\\"}"\nnext := ~/,/ cell\ncell := /[^,\\n]*/',
    "json_to_csv": 'main := (~/\\{"id":"/ cell ~/","name":"/ "," cell ~/","place":"/ "," cell ~/"\\}/ /\\n/)*\ncell := /[^"\\n]*/',
    "json_object_to_sql": 'main := "INSERT INTO t VALUES\\n" row ("," row)* ";\\n"\nrow := ~/\\{/ ~blank "(" field ("," ~/,/ ~blank field)* ")" ~/\\}\\n?/\nfield := ~jtext ~/:/ ~blank value\nvalue := jtext | /-?[0-9]+(\\.[0-9]+)?/ | ~/null/ "NULL" | /true|false/\nblank := / */\n' + _JSON_TEXT,
    "json_mask_key": 'main := (pair | /./)*\npair := /"email": */ ~jtext "\\"***\\""\n' + _JSON_TEXT,
    "json_keep_known_keys": 'main := (object /\\n/)*\nobject := /\\{/ (entry rest* | 1) /\\}/\nrest := ~/,/ "," entry\nentry := known | "\\"unknown\\":" ~jtext ~/:/ "0" ~value\nknown := /"(id|name)":/ value\nvalue := jtext | /[0-9]+/\n' + _JSON_TEXT,
    "timestamp_to_json": 'main := (stamp /\\n/)*\nstamp := "{\\"date\\":\\"" /[0-9]{4}-[0-9]{2}-[0-9]{2}/ ~/T/ "\\",\\"time\\":\\"" /[0-9]{2}:[0-9]{2}:[0-9]{2}/ "\\",\\"zone\\":\\"" /Z|[+-][0-9]{2}:[0-9]{2}/ "\\"}"',
    # logs and messages
    "access_log_to_json": 'main := "[" (entry ("," entry)*)? "]\\n"\nentry := "{\\"host\\":\\"" /[0-9.]+/ ~/ [^ ]+ [^ ]+ \\[/ "\\",\\"when\\":\\"" /[^\\]\\n]+/ ~/\\] / "\\",\\"request\\":" quoted ~/ / ",\\"status\\":" /[0-9]{3}/ ~/ / ",\\"bytes\\":" (/[0-9]+/ | ~/-/ "0") ~/[^\\n]*\\n/ "}"\nquoted := /"([^"\\\\\\n]|\\\\[^\\n])*"/',
    "chat_message_parts": 'main := (message | "bad: " /[^\\r\\n]*/ ~end "\\n")*\nmessage := (~/:/ "from " /[^ \\r\\n]+/ "; " ~/ /)? "command " (/[A-Za-z]+/ | /[0-9]{3}/) param{,14} (~/ :/ "; text " /[^\\r\\n]*/)? ~end "\\n"\nparam := ~/ / "; " /[^: \\r\\n][^ \\r\\n]*/\nend := /\\r?\\n/',
    "log_fields_reordered": 'main := (~/[^|\\n]*\\|/ a@/[^|\\n]*/ ~/\\|/ b@/[^|\\n]*/ ~/\\|[^\\n]*/ !b "\\t" !a /\\n/)*',
    "web_answer": 'main := ok | "HTTP/1.1 404 Not Found\\n\\n" ~/.*/\nok := ~/GET \\/(index\\.html)? HTTP\\/1\\.[01]\\r?\\n/ "HTTP/1.1 200 OK\\n\\nhello\\n" ~/.*/',
    # addresses
    "addresses": 'main := (address /\\n/ | ~/[^\\n]*\\n/)*\naddress := /[A-Za-z0-9!#$%&\'*+\\/=?^_`{|}~.-]+/ /@/ label (/\\./ label)+\nlabel := /[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?/',
    "address_check": "main := ~ok*\nok := /[a-z0-9._-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+\\n/",
    "link_parts": 'main := (link /\\n/)*\nlink := "scheme " /[a-z][a-z0-9+.-]*/ ~/:\\/\\// login? "; host " /[^:\\/?#@\\n]+/ (~/:/ "; port " /[0-9]+/)? ("; path " /\\/[^\\n]*/)?\nlogin := "; user " /[^:@\\/\\n]+/ (~/:/ "; password " /[^@\\/\\n]*/)? ~/@/',
    # documents
    "sections_to_json": 'start: clean >> convert\nclean := (~/[ \\t]*(;[^\\n]*)?\\n/ | /[^\\n]+\\n/)*\nconvert := "{" (section ("," section)*)? "}\\n"\nsection := ~/\\[/ "\\"" /[^\\]\\n]+/ "\\":{" ~/\\][ \\t]*\\n/ (pair ("," pair)*)? "}"\npair := "\\"" /[^=\\[ \\t\\n]+/ "\\":" ~/[ \\t]*=[ \\t]*/ (/"[^"\\n]*"/ ~/[ \\t]*/ | "\\"" plain* "\\"") ~/\\n/\nplain := ~/\\\\/ "\\\\\\\\" | ~/"/ "\\\\\\"" | /[^\\n]/',
    "outline_to_html": 'start: blocks >> spans\nblocks := (block /\\n/)*\nblock := "<h2>" ~/## / text "</h2>" | "<h1>" ~/# / text "</h1>" | "<ul>" item (~/\\n/ item)* "</ul>" | "<hr/>" ~/-{3,}/ | "<p>" /[^\\n]+/ "</p>" | 1\nitem := "<li>" ~/[*+-] / text "</li>"\ntext := /[^\\n]*/\nspans := ("<b>" ~/\\*\\*/ /[^*\\n]+/ "</b>" ~/\\*\\*/ | "<i>" ~/\\*/ /[^*\\n]+/ "</i>" ~/\\*/ | "<code>" ~/`/ /[^`\\n]+/ "</code>" ~/`/ | ~/\\[/ name@/[^\\]\\n]+/ ~/\\]\\(/ "<a href=\\"" /[^)\\n]+/ ~/\\)/ "\\">" !name "</a>" | /./)*',
    "tags_only": "main := (/<[^>]*>/ | ~/./)*",
    "without_comment_lines": "main := (~/\\/\\/[^\\n]*\\n/ | /[^\\n]*\\n/)*",
    "quoted_words": 'main := ("\\"" /[a-zA-Z]+/ "\\"" | /./)*',
    "title_first": "main := (head title? | /\\n/)*\nhead := /@[a-z]+\\{[^\\n]*\\n/ (other@(/ *[a-su-z][^\\n]*\\n/ | / *t[a-hj-z][^\\n]*\\n/) [others += other])*\ntitle := / *title[^\\n]*\\n/ !others (/ *[a-z][^\\n]*\\n/)* /\\}\\n/",
    "source_colours": 'main := ("<k>" /(if|else|while|return)/ "</k>" | "<s>" /"[^"\\n]*"/ "</s>" | "<c>" /\\/\\/[^\\n]*/ "</c>" | "<n>" /[0-9]+/ "</n>" | /[A-Za-z_]+/ | /./)*',
    "string_literals": 'main := (~/"/ /[^"\\\\\\n]*/ ~/"/ "\\n" | ~/./)*',
    "form_target": 'main := (/<form action="/ url@/[^"]*/ "/proxy?to=" !url /"/ | /./)*',
    # motifs
    "motif_names": 'main := (~/agggtaaa|tttaccct/ "A " | ~/[cgt]gggtaaa|tttaccc[acg]/ "B " | ~/./)*',
    "words_translated": 'main := (word | /./)*\nword := ~/the/ "la" | ~/house/ "casa" | ~/red/ "rossa" | /[a-z]+/',
}


def get(name: str, **options) -> Program:
    return compile_program(PROGRAMS[name], **options)
