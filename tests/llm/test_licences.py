from drivetrove.llm.licences import RULES, SENTENCES, licences

MIT = """MIT License

Copyright (c) someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
"""


def test_licences(spark, docs):
    rows = [
        (1, MIT), (2, None), (3, ""), (None, "x.\nReleased under the MIT License."), (5, "no clue here. at all"),
        (6, "Licensed under the Apache License, Version 2.0.\nfoo bar. Licensed under CC BY-NC 4.0."), (6, "word " * 50000 + ". All rights reserved; copyright."),
        (7, "The permission was given. License of art"), (8, "text without end\nLicensed under the Apache License, Version 2.0"),
        (9, "This program is free software: you may not.  See the GNU General Public License for more details."),
        (10, "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n"),
    ]
    got = sorted((str(r["doc_id"]), r["n_known"], r["licences"], r["unmatched"]) for r in licences(docs(rows)).collect())
    assert got == sorted([
        ("1", 3, "MIT", ""), ("2", 0, "", ""), ("3", 0, "", ""), ("None", 1, "MIT", ""), ("5", 0, "", ""), ("6", 2, "Apache-2.0,CC-BY-NC-4.0", ""),
        ("6", 0, "", ""), ("7", 0, "", ""), ("8", 1, "Apache-2.0", ""), ("9", 2, "", "gpl_free,gpl_details"), ("10", 2, "Apache-2.0", ""),
    ])
    assert licences(docs(rows).limit(0)).count() == 0


def test_tables():
    used = {x.rstrip("?") for _, rule in RULES for x in rule}
    assert used == set(SENTENCES)
    every = [s for v in SENTENCES.values() for s in v]
    assert len(every) == len(set(every))
