"""Sources and sinks: landed pages and JSON into raw offers, robots rules, sitemaps, exports.

Fetching is not part of the engine: files are landed by other means, and are read here as tables.
"""
