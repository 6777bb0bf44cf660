from loomgraph.llm import names


def test_parse():
    assert names.parse("Silmawúmi, Francisco") == {"words": ["silmawumi", "francisco"], "initials": [], "comma": True, "login": False}
    assert names.parse("M.L. Frowovdahl")["initials"] == ["m", "l"] and names.parse("CB Eskvejdahl")["initials"] == ["c", "b"]
    assert names.parse("kostya.frow@x.example")["words"] == ["kostya", "frow"] and names.parse("lun.d")["initials"] == ["d"]
    assert names.parse("A B <a.b@c.d>")["initials"] == ["a", "b"] and names.parse("DOROTHEA CAS")["words"] == ["dorothea", "cas"]
    for odd in (None, "", "   ", "?!", "123", "x" * 10_000):
        names.parse(odd)


def test_similarities():
    assert names.slip("lunkidley", "lunkiddley") and names.slip("frowo", "frwoo") and names.slip("octava", "octavia") and not names.slip("abcd", "abxy")
    assert names.monge_elkan(["nardo", "cor"], ["cor", "leonardo"]) == 1.0 and names.monge_elkan(["zoe", "smith"], ["tom", "jones"]) < 0.7
    bands, rows = names.banding()
    assert names.curve(bands, rows, names.AT) >= names.WANTED and names.curve(bands, rows, 0.1) < 0.5


def test_links(spark):
    people = [("1", "Leonardo Corciw"), ("2", "Corciw Leonardo"), ("3", "Leonardo Corcciw"), ("4", "Patricia Corciw"), ("5", "Leonardo Halvard"), ("6", "merge-bot"), ("7", None), ("8", ""), ("1", "Leonardo Corciw"), ("9", "Patricia Halvard")]
    aliases = [("1", "quietforge7"), ("1", None), ("zz", "x")]
    actors = ["Nardo Corciw", "L. Corciw", "lcorciw", "CORCIW, Leonardo", "quietforge7", "merge-bot", None, "", "P. Corciw", "leonardo.halvard@x.example", "Leonardo Corciw", "Nobody Known"]
    got = names.link_people(
        spark.createDataFrame([(*x, "a") for x in people], "id string, name string, human string"),
        spark.createDataFrame(aliases, "entity_id string, alias string"),
        spark.createDataFrame([(a,) for a in actors], "actor string"),
    )
    rows = {(r["link_kind"], r["left_key"], r["right_key"]) for r in got.collect()}
    assert {r[1:] for r in rows if r[0] == "entity_entity"} == {("1", "2"), ("1", "3"), ("2", "3")}
    acted = {}
    for kind, a, b in rows:
        if kind == "actor_entity":
            acted.setdefault(a, set()).add(b)
    one = {"1", "2", "3"}
    assert acted == {"Nardo Corciw": one, "L. Corciw": one, "lcorciw": one, "CORCIW, Leonardo": one, "quietforge7": one, "P. Corciw": {"4"}, "leonardo.halvard@x.example": {"5"}, "Leonardo Corciw": {"2", "3"}}


def test_empty(spark):
    assert names.link_people(spark.createDataFrame([], "id string, name string"), spark.createDataFrame([], "entity_id string, alias string"), spark.createDataFrame([], "actor string")).count() == 0


def test_a_slip_of_many_spellings_is_still_a_slip(spark):
    tokens = [("alexxander", 6), ("alexander", 90), ("torroeski", 9), ("torropski", 30), ("lundgren", 40), ("lindgren", 50)]
    got = {r["token"]: r["star"] for r in names.stars(spark.createDataFrame(tokens, "token string, n long")).collect()}
    assert got == {"alexxander": "alexander", "alexander": "alexander", "torroeski": "torroeski", "torropski": "torropski", "lundgren": "lundgren", "lindgren": "lindgren"}
