"""All registered queries of the library and their SQL."""

from gridloom.plans import activity, assembly, fields, files, frames, geodesy, inputs, naming, pixels, points, quality, reports, scalars, selection, stores, streams, verification

_ALL: dict = {}
for _module in (activity, verification, pixels, quality, points, scalars, assembly, fields, files, frames, geodesy, inputs, naming, reports, selection, stores, streams):
    _ALL |= _module.QUERIES

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
