"""License notices inside documents: MinHash bands over overlapping windows retrieve templates, shingles verify them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.text import normal_words, shingles, slices
from starloom.llm.windows import Blocks, ItemIndex, ShortItems, without_short

# Usual license notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation; either version 2 of the "
                         "License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                          "the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Lesser General Public License as published by the Free Software Foundation, either version 3 of "
                          "the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                          "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                          "the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. THIS "
                     "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
            "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    *((f"{name}", f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0",
        "EPL-2.0", "CC0-1.0",
    )),
]
# Notices of fewer words than a shingle.
SHORT_NOTICES = [
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."), ("MIT", "MIT License"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"), ("Unlicense", "SPDX-License-Identifier: Unlicense"), ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License 2.0"),
]


def whole_texts() -> list[tuple[str, str]]:
    """Whole license bodies; read by the driver only."""
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"}
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(names.get(f.stem, f.stem), f.read_text(encoding="utf-8")) for f in files]


@dataclass(frozen=True)
class LicenseParams:
    """48 bands of one function: a notice with 80 % of a template's shingles shares one with probability 0.99996."""

    width: int = 5
    containment: float = 0.8
    bands: int = 48
    rows: int = 1


def license_notices(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, params: LicenseParams = LicenseParams()
) -> DataFrame:
    """``doc_id, license, template, n_shared, n_shingles, containment``: a row for each template found in each row.

    ``template`` is the place in the list, which is part of the program, so small.  Matching ignores case, punctuation
    and line breaks.  A template of fewer words than a shingle is found wherever its words stand in a row.  Null and empty texts contain nothing; repeated rows give repeated results; null ids stay null.
    """
    templates = TEMPLATES if templates is None else templates
    names = [name for name, _ in templates]
    words, at = normal_words(pa.array([text for _, text in templates], pa.large_string()))
    short = ShortItems.of(words, at, params.width)
    prints, first = without_short(words, at, params.width)
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex.of(prints, first, params.bands, params.rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        sizes = np.diff(known.first)
        for piece in slices(batches, "text"):
            words, at = normal_words(piece.column("text"))
            prints, first = shingles(words, at, params.width)
            doc, item = known.candidates(Blocks.of(prints, first, params.bands * params.rows))
            shared = known.contained(doc, item, prints, first)
            found = shared >= np.ceil(params.containment * sizes[item] - 1e-9)
            doc, item, shared, size = doc[found], item[found], shared[found], sizes[item[found]]
            more_doc, more = short.inside(words, at)
            doc, item = np.concatenate([doc, more_doc]), np.concatenate([item, more])
            shared, size = (np.concatenate([x, np.ones(len(more), np.int64)]) for x in (shared, size))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": piece.column("doc_id").take(pa.array(doc)), "license": pa.array([names[i] for i in item], pa.string()),
                    "template": pa.array(item.astype(np.int32)), "n_shared": pa.array(shared), "n_shingles": pa.array(size),
                    "containment": pa.array(shared / np.maximum(size, 1)),
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        search, "doc_id BIGINT, license STRING, template INT, n_shared BIGINT, n_shingles BIGINT, containment DOUBLE"
    )


def op6_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices in all documents."""
    return license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEMPLATES + SHORT_NOTICES + whole_texts())
