"""lathe.plans"""
