"""Part of exprlake; see the README."""
