"""Analytics over content-addressed data, as lazy DataFrame and SQL plans."""
