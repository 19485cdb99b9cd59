"""Licences as they are met: named within sentences, tagged, wrapped, with holders' names."""

import pytest

from tallyloom.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CASES = {
    "This project is licensed under the MIT License.": "MIT",
    "You may copy it under the terms of the MIT license, and sell it.": "MIT",
    "// SPDX-License-Identifier: MIT\nint main;": "MIT",
    "/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later) */": "Apache-2.0,GPL-2.0-or-later",
    "# SPDX-License-Identifier: LGPL-3.0-only\n": "LGPL-3.0-only",
    "Copyright (c) 2020 Some One\n" + MIT: "MIT",
    "MIT License\n\nCopyright 2020 Some One\nand others\n\n" + MIT: "MIT",
    "The MIT License (MIT)\n": "MIT",
    "Copyright (c) 1998, A University\nAll rights reserved.\n\n" + BSD: "BSD-2-Clause",
    BSD + "3. Neither the name of the Example Foundation, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    BSD + "* Neither the name of A University nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n": "BSD-3-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0-or-later",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "GPL-3.0-or-later",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "LGPL-3.0-or-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "A driving license is needed here. So is the MIT, and a licensed pilot.": "",
    "The above copyright notice and so on, as the MIT people say.": "",
}


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_case(spark, text):
    rows = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert rows[0].licenses == CASES[text]


def test_cases_in_sql(spark, tmp_path):
    import duckdb

    rows = [*enumerate(CASES), (100, None), (101, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = duck.execute(licenses.scan_sql()).fetchall()
    got = [tuple(r) for r in licenses.scanned(frame).select("doc_id", "sentence_ids", "licenses", "n_sentences").collect()]
    assert sorted(got) == sorted(want)


def test_no_phrase_is_part_of_another():
    words = [f" {p} " for p in licenses.PHRASES.values()]
    assert not any(a != b and a in b for a in words for b in words)
    tags = [w for _, w in licenses.tagged()]
    assert not any(a != b and a in b for a in tags for b in tags)
    used = {name for _, rule in licenses.RULES for name in rule}
    assert used >= set(licenses.PHRASES) | {name for name, _ in licenses.tagged()}
