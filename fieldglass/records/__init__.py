"""Typed records and summaries out of logs, reports, captures and engineering texts.

Formats without a pinned meaning (HTTP archives, traces, static-analysis and
test reports, bills of material, tracks, maps, notebooks) follow their public
specifications; the choices made are written next to each function.
"""
