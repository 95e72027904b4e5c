"""Training-data operators: ten dealt methods, each over whole tables. Nothing else in exprlake imports this."""
