"""Siderite sources."""
