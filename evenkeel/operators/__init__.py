"""Building blocks: stream shape, sketches, placement, routing, metrics."""
