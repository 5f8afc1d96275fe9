"""Lists of licences, SPDX expressions and sentences that only look like notices."""

import pytest

from vouchlake.llm import license_scan

TEXTS = {
    "The tool is distributed by ISC.": "",
    "Images are covered by BSD.": "",
    "GCC is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 3, or (at your option)\nany later version.\n": "GPL-3.0-or-later",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n": "Apache-2.0",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "",
    "Licensed under either of Apache License, Version 2.0 or MIT license.": "Apache-2.0,MIT",
    "The code is licensed under the MIT, BSD 3-Clause and ISC.": "BSD-3-Clause,ISC,MIT",
    "This file is dual licensed under the GPL version 2 or later and the MIT license.": "GPL-2.0-or-later,MIT",
    "SPDX-License-Identifier: GPL-2.0-or-later AND BSD-2-Clause": "BSD-2-Clause,GPL-2.0-or-later",
    "The code is released under the MIT License.": "MIT",
    "It is not licensed under the MIT License.": "",
    "x " * 200_000 + "\nReleased under the MIT License.\n": "MIT",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    return {rows[r["doc_id"]][1]: r["licenses"] for r in license_scan.scan(docs).collect()}


@pytest.mark.parametrize("text", [t for t in TEXTS if "at your option." not in t])
def test_licences_of_a_text(found, text):
    assert found[text] == TEXTS[text]
