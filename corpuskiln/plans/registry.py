"""Every query of the library, by name, with its SQL."""

from __future__ import annotations

from corpuskiln.plans import contracts, forms, records, reports, resumes, sft, structure, templates, texts

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (sft, texts, records, forms, resumes, contracts, templates, reports, structure):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
