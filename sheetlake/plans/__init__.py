"""Plan-shaping helpers and composite plans."""
