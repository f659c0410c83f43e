"""Jobs over whole tables of requests and plans."""
