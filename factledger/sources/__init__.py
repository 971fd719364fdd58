"""factledger sources."""
