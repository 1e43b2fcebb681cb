"""Sources: returns, tile catalogues, AOI documents, LAS files, synthetic scenes."""
