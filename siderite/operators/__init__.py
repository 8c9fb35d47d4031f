"""Siderite operators."""
