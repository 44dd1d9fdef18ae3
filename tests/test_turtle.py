"""Turtle in splits of all sizes against its N-Triples form."""

import pytest

from weftgraph.sources.graph import ntriples, read_ntriples, read_ntriples_faults
from weftgraph.sources.terms import iri
from weftgraph.sources.turtle import NORMAL, Statements, after_line, read_turtle, unescaped
from pyspark.sql import functions as F

HEAD = """@prefix ex: <http://e/> .
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
@base <http://base/dir/> .
# a comment with a dot .
"""


def body(n):
    out = []
    for i in range(n):
        out.append(f'''ex:s{i} a ex:Thing ;   # "quoted" in a comment '''+f'''
   ex:label "name {i}"@EN-gb , 'it''s'@de ;;
   ex:size {i} , -{i}.5 , {i}e3 , true ;
   ex:long """first "line" . of {i}
@prefix ex: <http://wrong/> .
ex:x ex:y ex:z .
''' + "''' last line \\u00e9\\t.\"\"\"" + f''' ;
   ex:list ( ex:a "b" [ ex:in {i} ] () ) ;
   <rel{i}> <../up> , _:b{i % 7} , ex:with\\,comma , ex:a.b:c .
_:b{i % 7} ex:p "x"^^xsd:token . [] ex:q ex:s{i} .
[ ex:r 1 ] .''')
        if i == n // 2:
            out.append("@prefix ex: <http://f/> .")
    return HEAD + "\n".join(out).replace("'it''s'", "'its'") + "\n"


def canonical(rows):
    """Triples with blank nodes named by what their neighbours are, round after round."""
    rows = [(tuple(r["s"]), r["p"], tuple(r["o"])) for r in rows]
    names = {x[1]: "" for s, _, o in rows for x in (s, o) if x[0] == 1}
    for _ in range(6):
        show = lambda x: (1, names[x[1]]) if x[0] == 1 else x
        near = {b: sorted([("o", p, repr(show(o))) for s, p, o in rows if s == (1, b, None, None)] + [("i", p, repr(show(s))) for s, p, o in rows if o == (1, b, None, None)]) for b in names}
        names = {b: str(hash(repr(v))) for b, v in near.items()}
    show = lambda x: (1, names[x[1]]) if x[0] == 1 else x
    return sorted(repr((show(s), p, show(o))) for s, p, o in rows)


@pytest.mark.parametrize("split", [200, 997, 1 << 20])
def test_splits_of_any_size(spark, tmp_path, split):
    text = body(9)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(text, encoding="utf-8")
    whole, fault = Statements({}, "", "w").read(text)
    assert fault is None and len(whole) == 9 * 25 and {x[2][1] for x in whole if x[1].endswith("/long")} == {f'first "line" . of {i}\n@prefix ex: <http://wrong/> .\nex:x ex:y ex:z .\n\'\'\' last line é\t.' for i in range(9)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        read = read_turtle(spark, str(tmp_path / "in"))
        got, faults = read.quads.collect(), read.faults.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [{"s": s, "p": p, "o": o} for s, p, o in set(whole)]
    assert faults == 0 and canonical(got) == canonical(want)
    ntriples(read.quads.select("s", iri(F.col("p")).alias("p"), "o")).write.text(str(tmp_path / "nt"))
    again = read_ntriples(spark, str(tmp_path / "nt")).collect()
    assert canonical(again) == canonical(got)


def test_faults_are_counted_and_the_rest_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix e: <http://e/> .\ne:a e:b e:c .\ne:a e:b .\nnone:a e:b 1 .\ne:d e:e "x" . e:d e:f "unclosed .\ne:g e:h 2 .\n')
    read = read_turtle(spark, str(tmp_path / "a.ttl"))
    assert sorted(r["o"]["lex"] for r in read.quads.collect()) == ["2", "http://e/c", "x"]
    assert sorted(r[0][:6] for r in read.faults.collect()) == ["e:a e:", "e:d e:", "none:a"]
    (tmp_path / "empty.ttl").write_text("")
    assert read_turtle(spark, str(tmp_path / "empty.ttl")).quads.count() == 0


def test_states_of_lines():
    assert after_line('a b """x', NORMAL) == (1, False) and after_line('y""" .', 1) == (NORMAL, True) and after_line("x .", 2) == (2, False)
    assert after_line('a b "x # ." . # end', NORMAL) == (NORMAL, True) and after_line("<http://e/#> . # x", NORMAL) == (NORMAL, True) and after_line("a b c # .", NORMAL) == (NORMAL, False)
    assert unescaped("\\u0041\\U0001F600\\\\n") == "A\U0001f600\\n"


def test_escapes_and_faults_of_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://e/a> <http://e/b> "\\u00e9\\U0001F600\\\\u0041 \\"q\\"" .\n# comment\n\n<http://e/a> <http://e/b> .\nnonsense\n<http://e/\\u00fc> <http://e/c> <http://e/d> .\n', encoding="utf-8")
    rows = read_ntriples(spark, str(tmp_path / "a.nt")).collect()
    assert sorted((r["s"]["lex"], r["o"]["lex"]) for r in rows) == [("http://e/a", 'é\U0001f600\\u0041 "q"'), ("http://e/ü", "http://e/d")]
    assert sorted(r[0] for r in read_ntriples_faults(spark, str(tmp_path / "a.nt")).collect()) == ["<http://e/a> <http://e/b> .", "nonsense"]
