"""Readers and writers: workbooks, page grids, files, text tables, persisted catalogues."""
