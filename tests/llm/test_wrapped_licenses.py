"""Licence notices wrapped at 80 columns, in comments, and with clauses behind semicolons."""

import textwrap

from tabsmith.llm import op06_licenses

MIT = ["Copyright (c) 2020 A Person", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
       "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
       "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
       "conditions:", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "",
       "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
       "and/or other materials provided with the distribution."]
BSD3 = [*BSD, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."]
GPL = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
       "Software Foundation, either version 3 of the License, or (at your option) any later version.", "",
       "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
       "FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."]
LGPL = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]
APACHE = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
          "copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0"]
NOTICES = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL, "LGPL-2.1-or-later": LGPL, "Apache-2.0": APACHE}


def forms(lines):
    for width in (60, 79, 10_000):
        out = [x for y in lines for x in (textwrap.wrap(y, width, break_long_words=False) or [""])]
        for mark in ("", "# ", "// ", " * ", ";; "):
            for end in ("\n", "\r\n"):
                yield end.join((mark + x).rstrip() for x in out)
        yield "/* " + "\n * ".join(out) + "\n */\nint main() { return 0; }"


def test_wrapped_and_commented(spark):
    rows = [(name, text) for name, lines in NOTICES.items() for text in forms(lines)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for r in op06_licenses.scan_licenses(docs).collect():
        # the clauses of BSD-2 stand in BSD-3 too
        want = ["BSD-2-Clause", "BSD-3-Clause"] if r.doc_id == "BSD-3-Clause" else [r.doc_id]
        assert r.licenses == want, r


def test_what_is_no_notice(spark):
    rows = [(0, "Released under\n\nthe MIT License"), (1, "not yet Released under the\nMIT License"), (2, "Licensed under the MIT. License"),
            (3, "x\x02Released under the MIT License"), (4, "Released under the MIT License\x03")]
    got = op06_licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {0: [], 1: [], 2: [], 3: [], 4: ["MIT"]}
