from twinpane.llm import licenses as li

MPL = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"


def test_statements_in_longer_lines_wrapped_headers_and_identifiers(spark):
    prose = "some words of a page that has nothing to say about such things "
    want = {
        "one_line": ("Released under the MIT License. Copyright 2020 Jane Doe and contributors, all rights reserved worldwide.", "MIT"),
        "paragraph": (prose * 5 + "Licensed under the Apache License, Version 2.0. " + prose * 5, "Apache-2.0"),
        "wrapped": (MPL + "import os\n" + "print(os.name)\n" * 90, "MPL-2.0"),
        "gpl2": ("/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\n" + "int x;\n" * 50, "GPL-2.0"),
        "none": (prose * 9 + "\nlicense\n", None),
        "unknown": ("SPDX-License-Identifier: Foo-9", None),
        "german": ("mit der Zeit und the mit", None),
        "null": (None, None),
    } | {x: (f"// SPDX-License-Identifier: {x}\n" + "code of a file\n" * 30, x) for x in li.SPDX}
    want |= {"later": ("# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1", "GPL-3.0")}
    files = spark.createDataFrame([(f"{k}/x.txt", v[0]) for k, v in want.items()], "path string, text string")
    assert {r.path.split("/")[0]: r.own_license for r in li.scan(files).collect()} == {k: v[1] for k, v in want.items()}


def test_a_wrapped_header_alone_is_a_licence_file(spark):
    files = spark.createDataFrame([("a/NOTES", MPL), ("a/b/x.py", "code")], "path string, text string")
    assert {(r.path, r.license, r.inherited_from) for r in li.scan(files).collect()} == {("a/NOTES", "MPL-2.0", None), ("a/b/x.py", "MPL-2.0", "a")}
