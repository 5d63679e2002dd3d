"""License notices in their usual layout."""

from __future__ import annotations

import pytest

from pulseframe.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("lead", ["", "# ", " * "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_notices(spark, lead, end):
    rows = [(i, end.join(lead + line for line in t.split("\n"))) for i, t in enumerate((MIT, BSD, MPL))]
    # a line without words between the halves, or another text, parts a notice
    rows += [(3, (end + lead + end).join(lead + line for line in BSD.split("\n"))), (4, BSD.split("\n")[0]), (5, BSD.split("\n")[1]), (6, None), (7, "\n\n")]
    got = {r["doc_id"]: [b["label"] for b in r["blocks"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ["mit"], 1: ["bsd"], 2: ["mpl"], 3: [], 4: [], 5: [], 6: [], 7: []}
