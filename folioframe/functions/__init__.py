"""Extension points and options of the engine: named stages, orders and binarisers, and the options that choose among them."""
