"""stressloom.sources"""
