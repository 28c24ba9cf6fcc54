import duckdb
import pytest
from conftest import AWKWARD
from oracle import difference

from siftframe.llm import licenses
from siftframe.llm.queries import ORACLES, op6_licenses
from siftframe.sources.scratch import scratch_path

WANT = {
    50: (1, 3, 3, ["mit"], ["mit"], 1.0),
    51: (2, 0, 2, ["apache", "gpl"], ["apache", "gpl"], 1.0),
    52: (0, None, None, [], ["cc-by-nc"], 1.0),
    53: (0, None, None, [], ["bsd"], 11 / 13),
    54: (0, None, None, [], [], 0.0),
    55: (3, 0, 4, ["mit"], ["mit"], 1.0),
}
ROWS = [
    (50, "released under the MIT\nLicense"),
    (51, "Apache-License; general public license"),
    (52, "filler " * 100 + "Licensed under CC BY-NC 4.0." + " filler" * 100),
    (53, "Redistribution and use in source and binary forms, with or without modification"),
    (54, "a license of public interest, general and mit"),
    (55, "mit license mit license mit license"),
]


def test_awkward_rows(docs_of):
    docs = docs_of(AWKWARD + ROWS).withColumnRenamed("source", "token").withColumnRenamed("lang", "row")
    out = licenses.find_licenses(docs).collect()
    assert len(out) == len(AWKWARD + ROWS)
    assert set(docs.columns) < set(out[0].asDict())
    for r in out:
        x = r["licenses"]
        have = (x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["score"])
        want = WANT.get(r["doc_id"], (0, None, None, [], [], 0.0))
        assert have[:5] == want[:5]
        assert have[5] == pytest.approx(want[5])
    sizes = {r["doc_id"]: r["licenses"]["n_words"] for r in out}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[6]) == (0, 0, 0, 1, 60_000)
    assert licenses.find_licenses(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = licenses.find_licenses(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_long_templates_are_refused(docs_of):
    with pytest.raises(ValueError, match="long"):
        licenses.find_licenses(docs_of(ROWS), templates=[("long", "word " * 26)])


SIBLINGS = [
    ("Licensed under CC BY 4.0.", ["cc-by"]),
    ("Licensed under CC BY-SA 4.0.", ["cc-by-sa"]),
    ("Licensed under CC BY-NC 4.0 by Jane", ["cc-by-nc"]),
    ("Licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa"]),
    ("Licensed under CC BY-ND 4.0", ["cc-by-nd"]),
    ("Licensed under CC BY-NC-ND 3.0", ["cc-by-nc-nd"]),
    ("Licensed under CC BY 4.0, the pictures under CC BY-NC 4.0", ["cc-by", "cc-by-nc"]),
    ("under the terms of the GNU General Public License", ["gpl"]),
    ("under the terms of the GNU Lesser General Public License", ["gpl", "lgpl"]),  # the phrase gives gpl
    ("it under the terms of the GNU Lesser Public License as published by the Free Software Foundation", ["lgpl"]),
    ("it under the terms of the GNU Public License as published by the Free Software Foundation", ["gpl"]),
    ("released under the BSD license", []),
    ("released under the new trade license", []),
    ("released under the Apache License", ["apache"]),
    ("This work is licensed under the GNU General Public License, version 3. Die tzente in mit.", ["gpl"]),
    ("released under the MIT or the Apache License", ["apache", "mit"]),
    ("licensed under the Mozilla Public License version 2.0", []),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mpl"]),
    ("This Source Code Form is subject to the terms of the Trade Public License, v. 2.0", []),
]


def test_siblings_are_told_apart(docs_of):
    out = licenses.find_licenses(docs_of([(i, t) for i, (t, _) in enumerate(SIBLINGS)])).collect()
    have = {SIBLINGS[r["doc_id"]][0]: r["licenses"]["labels"] for r in out}
    assert have == dict(SIBLINGS)


def test_sql_knows_marks_and_siblings(spark, docs_of):
    filler = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((0, 3, 20, 40))]
    notices = [text for _, text in licenses.TEMPLATES + licenses.SIBLINGS] + [
        "licensed under creative commons by nc 4 0",
        "released under the wtf license",
        "bericht mit der licensed under the apache license version 2 0 released",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
        "it under the terms of the gnu license as published by the free software foundation",
        "nc by licensed under cc 4 0 by",
    ]
    texts = [f"{a} {n} {b}" for n in notices for a in filler for b in filler]
    texts += [f"{a} {b}" for a in notices for b in notices]
    folder = scratch_path(spark, "test-licenses")
    docs_of([*AWKWARD, *enumerate(texts, 100)]).coalesce(4).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder.removeprefix('file:')}/documents.parquet/*.parquet')")
    assert difference(op6_licenses(spark, folder), con, ORACLES["op6_licenses"]) is None
