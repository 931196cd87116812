"""Licence notices as they stand in files: wrapped, inside sentences, and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.llm import licenses

MIT = """MIT License

Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
CODE = "\n".join(f"int f{i}(int x) {{ return x + {i}; }}" for i in range(80))
APACHE = """/*
 * Copyright 2020 Some Company
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 */
"""
GPL = """# This program is free software: you can redistribute it and/or
# modify it under the terms of the GNU General Public License as
# published by the Free Software Foundation, either version 3 of
# the License, or (at your option) any later version.
"""
WRAPPED = "// Some tool of ours. Released under\n// the MIT\n// License. See the manual for the rest.\n"
FILES = (
    ("a/TEXT", MIT, "MIT", "own"), ("a/x.c", "int x;", "MIT", "inherited"), ("b/y.c", APACHE + CODE, "Apache-2.0", "own"), ("c/z.py", GPL + CODE, "GPL-3.0", "own"), ("d/w.c", WRAPPED + CODE, "MIT", "own"),
    ("e/p.txt", "The pictures of this report were drawn by hand. Licensed under CC BY 4.0. Contact us for other uses.", "CC-BY-4.0", "own"),
    ("f/LICENSE", "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n" + CODE, "Apache-2.0", "own"), ("f/v.c", "int v;", "Apache-2.0", "inherited"),
    ("g/n.txt", "A driving license is needed here, and the public may ask for a copyright notice of the pictures.", None, None),
)


def test_notices_and_texts(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(FILES)], "doc_id long, p string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan(df, F.col("p")).collect()}
    assert got == {p: (name, origin) for p, _, name, origin in FILES}
