"""Plan helpers: written intermediates that cut lineage, iteration drivers."""
