"""Readers and writers: area catalogues, messages, elevation rasters, file listings, archives, exports."""
