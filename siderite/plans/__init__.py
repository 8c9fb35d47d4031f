"""Siderite plans."""
