"""Exact top-k and licence scans."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicor.llm import licenses, topk


def brute_topk(rows, k=5, every=3):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        scores = [(-sum(a * b for a, b in zip(v, w)), j) for i, v in ok if i == q for j, w in ok if j != q]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("shard_rows, big", [(8192, 1.0), (40, 1.0), (40, 3e6)])
def test_topk_equals_brute_force(spark, shard_rows, big):
    rng = random.Random(shard_rows)
    rows = [(i, [float(np.float32(rng.gauss(0, big))) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(30)]
    rows += [(900, None), (903, [None] * 6), (906, [float("nan")] * 6), (909, [float("inf")] * 6), (None, rows[0][1]), (912, []),
             (915, [0.0] * 6), (918, [1.0, 2.0]), (3, rows[9][1])]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = topk.top_k(table, F.col("vec_id") % 3 == 0, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows)


def test_topk_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect())) == [
        (0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_skips_blocks_and_keeps_results():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 1000, (2000, 1)), axis=0)
    ids = np.arange(2000)
    at, names, scores = topk.search_blocks(np.array([-1]), np.array([[3]]), np.array([topk._LOW]), ids, v, 4, 100)
    assert scores.tolist() == (3 * np.sort(v[:, 0])[::-1][:4]).tolist() and set(at) == {0} and len(names) == 4


def test_license_rules(spark):
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
              "with the License.\nUnless required by applicable law or agreed to in writing, software distributed under the License "
              "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
    bsd = [licenses.SENTENCES[i] for i in ("s19", "s20", "s21", "s22")]
    cases = [(None, "", ""), ("", "", ""), ("nothing here", "", ""), ("Text.\nReleased under the MIT License.", "s03", "MIT"),
             ("Licensed under CC BY-NC 4.0. x\nReleased under the MIT License.", "s13,s03", "CC-BY-NC-4.0,MIT"),
             (apache, "s06,s07,s08", "Apache-2.0"), (". \n".join(bsd) + ".", "s19,s20,s21,s22", "BSD-2-Clause,BSD-3-Clause"),
             (". ".join(reversed(bsd)) + ".", "s22,s21,s20,s19", ""),
             (f"{bsd[0]}. other words. {bsd[1]}.\n{bsd[2]}!", "s19,s20,s21", "BSD-2-Clause"),
             (". ".join(x.replace(" in ", "\nin ").replace(" the ", " the\n") for x in bsd[:3]) + ".", "s19,s20,s21", "BSD-2-Clause"),
             ("x" * 200_000 + "\nreleased  UNDER the mit license\n" * 50, ",".join(["s03"] * 50), "MIT")]
    docs = spark.createDataFrame([(i, t, "l", None) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string, licenses string, s string")
    got = licenses.scan(docs).orderBy("doc_id").select(F.array_join("sentence_ids", ","), F.array_join("licenses", ",")).collect()
    assert [tuple(r) for r in got] == [(a, b) for _, a, b in cases]
    assert licenses.scan(docs.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """# This program is free software{mark} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{comma} either version {n} of the License, or
# (at your option) any later version.
"""


def found_in(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id").collect()
    return [(",".join(r["sentence_ids"]), ",".join(r["licenses"])) for r in rows]


def test_license_texts_in_their_usual_spelling(spark):
    spdx = {"MIT": "s24", "Apache-2.0": "s25", "GPL-3.0-only": "s26", "GPL-2.0-only": "s27"}
    cases = [(MIT, "s01,s02", "MIT"), (MIT.replace("\n", "\r\n"), "s01,s02", "MIT"),
             (GPL.format(mark=":", comma=",", n=3), "s11", "GPL-3.0"), (GPL.format(mark=";", comma=";", n=2), "s12", "GPL-2.0"),
             (" ".join(GPL.format(mark=":", comma=",", n=3).replace("#", "").split()), "s11", "GPL-3.0"),
             *[(f"// SPDX-License-Identifier: {x}\nint main();", i, x.removesuffix("-only")) for x, i in spdx.items()],
             ("SPDX-License-Identifier: MIT OR Zlib", "", ""), ("not released under the MIT License.", "", ""),
             ("a|SPDX-License-Identifier: MIT|b", "", ""), ("|| Released: under\n--\nthe MIT; License ||", "s03", "MIT")]
    assert found_in(spark, [t for t, _, _ in cases]) == [(a, b) for _, a, b in cases]


def test_notices_and_wrapped_texts_of_one_text(spark):
    notices = "Released under the MIT License\nLicensed under the MIT License\nLicensed under CC BY-NC 4.0\n"
    apache = 'Licensed under the Apache License, Version 2.0\n(the "License");\nyou may not use this file except in\ncompliance with the License.'
    cases = [(notices + MIT, "s03,s04,s13,s01,s02", "CC-BY-NC-4.0,MIT"), (MIT + "\n" + notices, "s01,s02,s03,s04,s13", "CC-BY-NC-4.0,MIT"),
             (GPL.format(mark=":", comma=",", n=3) + "\nLicensed under CC BY 4.0\n" + MIT, "s11,s14,s01,s02", "CC-BY-4.0,GPL-3.0,MIT"),
             ("Licensed under CC BY 4.0\nThis is free and unencumbered software released\ninto the public domain.", "s14,s23", "CC-BY-4.0,Unlicense"),
             (apache, "s05,s06,s07", "Apache-2.0"), (apache.replace("\n", " "), "s06,s07", "Apache-2.0"),
             ('Licensed under the Apache License, Version 2.0\n(the "License");', "s05,s06", "Apache-2.0")]
    assert found_in(spark, [t for t, _, _ in cases]) == [(a, b) for _, a, b in cases]
