"""DataFrame operators over long tables with explicit keys."""
