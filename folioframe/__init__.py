"""Document-layout analytics on Spark: positioned glyphs in, Markdown out, one DataFrame per step."""
